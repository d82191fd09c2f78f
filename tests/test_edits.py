"""The fold of an edit log against edits applied in turn."""

import random

from shoal.operators.edits import fold

LOG = "seq long, op string, id long, member long, name string, text string"


def in_turn(log, groups):
    names, hidden, into, aliases, folders, queries, members, deleted, loose = {}, set(), {}, {}, {}, {}, {}, {}, set()
    dead, kept = set(), {}
    for seq, op, i, m, _, _ in log:
        if op == "keep":
            kept.setdefault((seq, i), set()).add(m)
    for seq, op, i, m, name, text in sorted(log, key=lambda r: r[0]):
        text = (text or "").strip() or None
        if i is None and op != "alias":
            continue
        if op == "rename":
            names[i] = text
        elif op == "hide":
            hidden.add(i)
            names[i] = None
        elif op == "merge":
            if i == m:
                continue
            if names.get(i) and not names.get(m):
                names[m] = names[i]
            names[i] = None
            hidden.discard(i)
            into[i] = m
        elif op == "unmerge":
            into.pop(i, None)
        elif op == "alias":
            aliases[name] = text
        elif op == "create_folder" and i not in dead:
            folders.setdefault(i, None)
            folders[i] = text or folders[i]
            members.setdefault(i, set())
        elif op == "rename_folder" and i in folders:
            folders[i] = text or folders[i]
        elif op == "smart_folder" and i in folders:
            queries[i] = text
        elif op == "delete_folder":
            if i in folders:
                dead.add(i)
                del folders[i]
                queries.pop(i, None)
                for p in members.pop(i):
                    if text == "photos":
                        deleted[p] = True
        elif op == "add_to_folder" and i in folders:
            members[i].add(m)
        elif op == "remove_from_folder" and i in folders:
            members[i].discard(m)
        elif op in ("delete", "restore"):
            deleted[i] = op == "delete"
        elif op == "prune":
            deleted[i] = True
            for s in members.values():
                s.discard(i)
        elif op == "keep":
            for p in groups.get(i, ()):
                if p not in kept[seq, i]:
                    deleted[p] = True
        elif op == "not_duplicate":
            loose.update(groups.get(i, ()))
    return ({k: v for k, v in names.items() if v}, hidden, into, {k: v for k, v in aliases.items() if v}, folders, {k: v for k, v in queries.items() if v}, {(f, p) for f, s in members.items() for p in s}, deleted, loose)


def folded(spark, log, groups):
    pairs = [(r, p) for r, ps in groups.items() for p in ps]
    f = fold(spark.createDataFrame(log, LOG), spark.createDataFrame(pairs, "rep long, photo_id long"))
    persons = f.persons.collect()
    return ({r["person_id"]: r["name"] for r in persons if r["name"]}, {r["person_id"] for r in persons if r["hidden"]}, {r["person_id"]: r["merged_into"] for r in persons if r["merged_into"] is not None},
            dict(tuple(r) for r in f.aliases.collect()), {r["folder"]: r["name"] for r in f.folders.collect()}, {r["folder"]: r["query"] for r in f.folders.collect() if r["query"]}, {tuple(r) for r in f.members.collect()},
            dict(tuple(r) for r in f.photos.collect()), {r[0] for r in f.not_duplicate.collect()})


def test_each_kind(spark):
    groups = {1: [1, 2, 3], 9: [9, 10]}
    log = [(1, "create_folder", 5, None, None, "Trip"), (2, "create_folder", 6, None, None, "Home"), (3, "add_to_folder", 5, 1, None, None), (4, "add_to_folder", 6, 1, None, None), (5, "add_to_folder", 5, 2, None, None),
           (6, "remove_from_folder", 5, 2, None, None), (7, "add_to_folder", 7, 1, None, None), (8, "rename", 40, None, None, " Ann "), (9, "merge", 40, 41, None, None), (10, "rename", 42, None, None, "Bob"), (11, "merge", 42, 41, None, None),
           (12, "hide", 43, None, None, None), (13, "merge", 43, 44, None, None), (14, "unmerge", 42, None, None, None), (15, "alias", None, None, "Rome", "home"), (16, "alias", None, None, "Oslo", "x"), (17, "alias", None, None, "Oslo", " "),
           (18, "keep", 1, 2, None, None), (18, "keep", 1, 3, None, None), (19, "restore", 1, None, None, None), (20, "keep", 9, None, None, None), (21, "not_duplicate", 1, None, None, None), (22, "prune", 1, None, None, None),
           (23, "add_to_folder", 6, 1, None, None), (24, "add_to_folder", 5, 30, None, None), (25, "delete_folder", 5, None, None, "photos"), (26, "add_to_folder", 5, 31, None, None), (27, "delete", None, None, None, None)]
    got = folded(spark, log, groups)
    assert got == in_turn(log, groups)
    names, _, into, aliases, folders, _, members, deleted, loose = got
    assert names == {41: "Ann"} and into == {40: 41, 43: 44} and aliases == {"Rome": "home"} and folders == {6: "Home"} and members == {(6, 1)}
    assert deleted == {1: True, 9: True, 10: True, 30: True} and loose == {1, 2, 3}
    assert all(not x for x in folded(spark, [], {}))


def test_random_logs(spark):
    ops = ["rename"] * 4 + ["hide", "merge", "merge", "unmerge", "alias", "create_folder", "create_folder", "rename_folder", "smart_folder", "delete_folder"] + ["add_to_folder"] * 6 + ["remove_from_folder", "delete", "restore", "prune", "keep", "not_duplicate"]
    groups = {k: [k, k + 1, k + 2] for k in range(0, 30, 3)}
    for seed in range(3):
        random.seed(seed)
        log = []
        for seq in range(500):
            op = random.choice(ops)
            i = random.randrange(30) if op not in ("keep", "not_duplicate") else random.choice(list(groups))
            text = "photos" if op == "delete_folder" and random.random() < 0.5 else random.choice([None, " ", f"t{seq}"]) if op != "delete_folder" else None
            log.append((seq, op, i, random.randrange(30), f"p{random.randrange(5)}", text))
        random.shuffle(log)
        got, want = folded(spark, log, groups), in_turn(log, groups)
        assert got == want
