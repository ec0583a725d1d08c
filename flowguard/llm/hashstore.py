"""Sorted hash arrays in the shared folder, memory-mapped by the workers that look things up.

A store is dealt into ``2 ** bits`` files by the leading bits of its keys. A file holds its sorted
64-bit keys, then a row of values for each; it is written under a name of its own and then
renamed, so that repeated or speculative tasks leave one whole file. Workers map files on first use:
the operating system pages in what is touched, and nothing is copied to a worker's disk.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import SparkSession

from flowguard.session import work_folder

#: Files that a worker keeps mapped.
OPEN = 1024
_open: OrderedDict[str, tuple[np.ndarray, np.ndarray]] = OrderedDict()


def mounted_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder of the shared one, as a path that driver and workers can open."""
    where = urlparse(work_folder(spark, name))
    if where.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need a shared folder that is mounted on all workers, not {where.scheme}://")
    folder = unquote(where.path)
    os.makedirs(folder, exist_ok=True)
    return folder


@dataclass(frozen=True)
class Store:
    """Names of the files of one kind; keys have ``width`` bits, and ``values`` values of type ``dtype`` each."""

    folder: str
    kind: str
    bits: int
    width: int
    values: int = 1
    dtype: str = "u8"

    def part(self, keys: np.ndarray) -> np.ndarray:
        """The file of each key."""
        return (keys >> np.uint64(self.width - self.bits)).astype(np.int32) if self.bits else np.zeros(len(keys), np.int32)

    def _path(self, part: int) -> str:
        return f"{self.folder}/{self.kind}-{part:06d}"

    def write(self, part: int, keys: np.ndarray, values: np.ndarray) -> None:
        own = f"{self._path(part)}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            f.write(keys.astype(np.uint64).tobytes())
            f.write(np.ascontiguousarray(values, self.dtype).tobytes())
        os.replace(own, self._path(part))

    def _map(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        path = self._path(part)
        if path in _open:
            _open.move_to_end(path)
            return _open[path]
        size = os.path.getsize(path) if os.path.exists(path) else 0
        n = size // (8 + np.dtype(self.dtype).itemsize * self.values)
        if n:
            raw = np.memmap(path, np.uint8, "r")
            pair = raw[: 8 * n].view(np.uint64), raw[8 * n :].view(self.dtype).reshape(n, self.values)
        else:
            pair = np.zeros(0, np.uint64), np.zeros((0, self.values), self.dtype)
        _open[path] = pair
        if len(_open) > OPEN:
            _open.popitem(last=False)
        return pair

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Values of sorted keys, zero for those that are absent."""
        out = np.zeros((len(keys), self.values), self.dtype)
        part = self.part(keys)
        edge = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(keys)]):
            if a == b:
                continue
            out[a:b] = self.look_in(int(part[a]), keys[a:b])
        return out

    def look_in(self, part: int, keys: np.ndarray) -> np.ndarray:
        """Values of keys in one file, zero for those that are absent."""
        out = np.zeros((len(keys), self.values), self.dtype)
        have, values = self._map(part)
        if len(have):
            k = np.minimum(np.searchsorted(have, keys), len(have) - 1)
            same = have[k] == keys
            out[same] = values[k[same]]
        return out

    def look_up_all(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys in any order, with repeats."""
        different, back = np.unique(keys, return_inverse=True)
        return self.look_up(different)[back]
