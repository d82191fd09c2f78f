"""URL filters by a bit-parallel wildcard automaton.

All glob rules are laid end to end over the bits of a few 64-bit words: one bit a
state, one mask a byte value. A batch of canonical URLs then steps through its bytes
together, each step being a Shift-And on every URL's words, so the cost doesn't
depend on how many rules there are beyond their words. Rules are a list the caller
holds; their masks (2 x 256 x words x 8 bytes) are the broadcast, and that is
their proven size.

Globs match a whole canonical URL. `*` is any run of bytes, `%` any run within the
host (no `/`), `?` one byte; `\\` takes the next character as it is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import share, shared


class Rule(NamedTuple):
    """A glob over canonical URLs. Of several that match, the highest rank wins, then the first."""

    glob: str
    name: str
    verdict: str
    rank: int


def host_rule(host: str, path: str, verdict: str) -> list[Rule]:
    """The rule of a host with all its subdomains and a path's start: a glob over `.host/path`."""
    quoted = "".join("\\" + c if c in "*%?\\" else c for c in f"{host.lower()}{path}")
    return [Rule(f"%.{quoted}*", f"{host}{path}", verdict, 1_000_000 + len(host) + len(path))]


#: Fixed values of the published contract: (host, path, verdict).
CONTRACT = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Default globs below every host rule: spam hosts and downloads that carry no text.
GLOBS = [("%cheap-pills%/*", "block"), ("%casino%/*", "block"), ("*.exe", "block"), ("*.zip", "block"), ("*.jpg", "block"), ("*.png", "block")]


def default_rules() -> list[Rule]:
    return [r for h, p, v in CONTRACT for r in host_rule(h, p, v)] + [Rule(g, "", v, len(g)) for g, v in GLOBS]


def canonical(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, `.host/path`): host after the first `://` with A-Z lower-cased, both empty without one."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.lit(2**31 - 1)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    host, path = F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))
    return host, path, F.concat(F.lit("."), host, path)


class Automaton:
    """Masks of the packed rules; `match` steps a batch of byte strings through them."""

    def __init__(self, globs: Sequence[str]):
        reads: list[np.ndarray] = []  # a state's 256 bytes; the start state of a rule reads none
        stays: list[np.ndarray] = []
        starts, self.ends = [], []
        for glob in globs:
            starts.append(len(reads))
            reads.append(np.zeros(256, bool))
            stays.append(np.zeros(256, bool))
            data, i = glob.encode(), 0
            while i < len(data):
                c, i = data[i : i + 1], i + 1
                if c in b"*%":
                    stays[-1] = stays[-1] | (np.arange(256) != 47 if c == b"%" else True)
                    continue
                if c == b"\\" and i < len(data):
                    c, i = data[i : i + 1], i + 1
                    reads.append(np.arange(256) == c[0])
                else:
                    reads.append(np.ones(256, bool) if c == b"?" else np.arange(256) == c[0])
                stays.append(np.zeros(256, bool))
            self.ends.append(len(reads) - 1)
        self.words = max(1, -(-len(reads) // 64))
        self.reads, self.stays = self._packed(reads), self._packed(stays)
        self.start = np.zeros(self.words, np.uint64)
        for s in starts:
            self.start[s // 64] |= np.uint64(1) << np.uint64(s % 64)

    def _packed(self, states: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((256, self.words), np.uint64)
        for s, accepts in enumerate(states):
            out[accepts, s // 64] |= np.uint64(1) << np.uint64(s % 64)
        return out

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """(texts, rules) booleans. The longest texts stay in play alone once the others have ended."""
        n = len(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        ends = np.cumsum(lengths)
        begin = (ends - lengths)[order]
        data, lengths = np.frombuffer(b"".join(texts), np.uint8), lengths[order]
        state = np.tile(self.start, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        live = n
        for i in range(int(lengths[0]) if n else 0):
            while live and lengths[live - 1] <= i:
                live -= 1
            c = data[begin[:live] + i]
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.reads[c]) | (now & self.stays[c])
        out = np.zeros((n, len(self.ends)), bool)
        for r, s in enumerate(self.ends):
            out[order, r] = (state[:, s // 64] >> np.uint64(s % 64)) & one != 0
        return out


def filter_urls(df: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict) of each row of df, repeats included.

    The rule is the name of the winning rule, null where that has none or none matches;
    then the verdict is the winning glob's or else `default`. A null or empty url, or one
    without `://`, has empty host and path and is matched as `.`. Other columns of df
    are ignored, whatever their names; an empty table gives an empty result. Very long
    urls are read whole.
    """
    ranked = sorted(range(len(rules)), key=lambda i: (-rules[i].rank, i))
    rules = [rules[i] for i in ranked]
    sent = share(df.sparkSession, Automaton([r.glob for r in rules]))
    names = np.array([r.name or None for r in rules] + [None], object)
    verdicts = np.array([r.verdict for r in rules] + [default], object)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared(sent, Automaton)
        for batch in batches:
            if not batch.num_rows:
                continue
            fits = automaton.match(batch.column(3).cast(pa.binary()).to_pylist())
            won = np.where(fits.any(1), fits.argmax(1), len(names) - 1) if fits.shape[1] else np.full(batch.num_rows, len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(names[won], pa.string()), pa.array(verdicts[won], pa.string())], names=[id_col, "host", "path", "rule", "verdict"])

    host, path, whole = canonical(F.col(url).cast("string"))
    rows = df.select(F.col(id_col), host.alias("host"), path.alias("path"), whole.alias("whole"))
    return rows.mapInArrow(judge, f"`{id_col}` {dict(rows.dtypes)[id_col]}, host string, path string, rule string, verdict string")
