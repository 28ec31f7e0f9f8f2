"""Word lists of any length, read by the workers from a sorted file.

The list is sorted by the cluster, streamed through the driver into one file and given to
the executors as a file of the session. Workers map it and search it by halves, so nobody
holds the words in memory, and a list of ten words and one of ten million are read alike.
"""

from __future__ import annotations

import atexit
import hashlib
import mmap
import os
import shutil
import tempfile
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

_FOLDER: list[str] = []


class WordList(Sequence):
    """Distinct words in the order of their characters, in a file: the words end to end, then the place of each word's first byte and of the end."""

    def __init__(self, name: str):
        self.name = name
        self._bytes: memoryview | None = None

    def __reduce__(self):
        return WordList, (self.name,)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, WordList) and self.name == other.name

    def __hash__(self) -> int:
        return hash(self.name)

    def _open(self) -> memoryview:
        if self._bytes is None:
            with open(SparkFiles.get(self.name), "rb") as f:
                m = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
            self._at = m[int.from_bytes(m[-8:], "little") :].cast("Q")
            self._bytes = m
        return self._bytes

    def __len__(self) -> int:
        self._open()
        return len(self._at) - 1

    def __getitem__(self, i: int) -> str:
        m = self._open()
        if not 0 <= i < len(self._at) - 1:
            raise IndexError(i)
        return str(m[self._at[i] : self._at[i + 1]], "utf-8")

    def __contains__(self, word: object) -> bool:
        i = bisect_left(self, word)
        return i < len(self) and self[i] == word


def word_list(lexicon: DataFrame, form: Callable[[str], str]) -> WordList:
    """The words of ``lexicon``, each in the form that ``form`` gives."""

    def formed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array([form(w) for w in b.column(0).to_pylist()], pa.string())], names=["word"])

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ws = b.column(0).cast(pa.binary()).to_pylist()
            sizes = np.array([len(w) for w in ws], "<u8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(ws)], pa.binary()), pa.array([sizes], pa.binary())], names=["words", "sizes"])

    words = lexicon.select("word").where("word is not null and word <> ''").mapInArrow(formed, "word string").distinct().orderBy("word")
    if not _FOLDER:
        _FOLDER.append(tempfile.mkdtemp(prefix="versoflow-words-"))
        atexit.register(shutil.rmtree, _FOLDER[0], True)
    seen, end = hashlib.blake2b(digest_size=16), 0
    with tempfile.NamedTemporaryFile(dir=_FOLDER[0], delete=False) as out, tempfile.TemporaryFile(dir=_FOLDER[0]) as at:
        at.write(bytes(8))
        for r in words.mapInArrow(packed, "words binary, sizes binary").toLocalIterator():
            out.write(r.words)
            ends = end + np.cumsum(np.frombuffer(r.sizes, "<u8"), dtype="<u8")
            at.write(ends.tobytes())
            end = int(ends[-1]) if len(ends) else end
            seen.update(r.words), seen.update(ends.tobytes())
        at.seek(0)
        shutil.copyfileobj(at, out)
    # The file of one content has one name, so a session gets it once.
    name = f"words-{seen.hexdigest()}"
    path = os.path.join(_FOLDER[0], name)
    os.replace(out.name, path)
    sc = lexicon.sparkSession.sparkContext
    if not any(os.path.basename(f) == name for f in sc.listFiles):
        sc.addFile(path)
    return WordList(name)
