"""Clusters that grow face by face, the same for a table and for a stream."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Clusters:
    """Clusters (centroid, photos, cover, its area) in the order of their making; `holds` says whether one held a photo before."""

    def __init__(self, least: float, larger: float, clusters: list[tuple] | None = None, holds: Callable[[int, int], bool] = lambda c, p: False):
        self.least, self.larger, self.clusters, self.holds = least, larger, list(clusters or []), holds
        self.centres = np.array([c[0] for c in self.clusters])
        self.new: set[tuple[int, int]] = set()

    def add(self, v: np.ndarray, photo: int, area: float) -> tuple[int, bool]:
        """(cluster, whether the photo is new to it) of a face: the most similar one above `least`, the first of equals, or one of its own.

        The centroid moves by the weight of one face against that of the cluster's photos.
        A face that is more than `larger` times the cover's area becomes the cover.
        """
        area = area or 0.0
        sims = self.centres @ v if len(self.clusters) else np.zeros(0)
        best = int(sims.argmax()) if len(sims) else -1
        if best >= 0 and sims[best] > self.least:
            _, photos, cover, held = self.clusters[best]
            moved = self.centres[best] * photos + v
            self.centres[best] = moved / (np.linalg.norm(moved) + 1e-10)
            fresh = (best, photo) not in self.new and not self.holds(best, photo)
            if area > self.larger * held:
                cover, held = photo, area
            self.clusters[best] = (self.centres[best].copy(), photos + fresh, cover, held)
        else:
            best, fresh = len(self.clusters), True
            centre = v / (np.linalg.norm(v) + 1e-10)
            self.centres = np.vstack([self.centres, centre]) if best else centre[None, :]
            self.clusters.append((centre, 1, photo, area))
        if fresh:
            self.new.add((best, photo))
        return best, fresh
