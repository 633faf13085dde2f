"""Sum-of-squares online packing of token sequences.

A document's ids are cut at the capacity; what is left over is an item that goes to the fill
level that minimises the sum of squared counts of partly filled windows (Csirik et al., the
Sum-of-Squares rule). The state is a level array: how many open windows have each fill, and
which. Each partition packs by itself, in one pass, with memory for its open windows only.

Windows that the rule leaves open when the input ends keep their items: the fullest are topped
up with what the least filled ones hold, cut to fit, so that only the latter are taken apart.
What is left in the end is cut into runs whose lengths are powers of two, which need no padding.
Where items do not fit together (all longer than half a window, say), windows stay open. So the
ids in open windows are bounded: beyond `held` of them the same is done, and what is left goes
on as an open window.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, way string"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes_of_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder(dict):
    """Token ids of whole texts, as little-endian uint32 bytes.

    Words between single spaces are looked up, with the space before them, in a bounded
    table: a byte-level vocabulary never joins ids over a boundary before a space that has
    no white space beside it. A text for which that does not hold (white space at the edge
    of a word, or a special token's string) is encoded as a whole. The short way's pattern goes
    back over white space step by step, so a text with a long run of it takes the slow way.
    """

    LONG_SPACE, LONGEST_KEPT = re.compile(r"\s{256}"), 64

    def __init__(self, path: str, limit: int = 250_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.limit = limit
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.piece = self._by_rank(spec) or self._slow

    def _slow(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def _by_rank(self, spec: dict):
        """The same byte-pair merges through ranks, if ids are in the order of merges."""
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec.get("normalizer"):
            return None
        vocab, symbols = spec["model"]["vocab"], _bytes_of_symbols()
        merged = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in spec["model"]["merges"]]
        if merged != list(range(256, 256 + len(merged))):
            return None
        try:
            import public_tokenizers
            import tiktoken
        except ImportError:
            return None
        ranks = {bytes(symbols[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda text: self._slow(text) if self.LONG_SPACE.search(text) else quick(text)

    def __missing__(self, word: str) -> bytes | None:
        edge = not word or word[0].isspace() or word[-1].isspace()
        ids = None if edge else np.array(self.piece(" " + word), dtype="<u4").tobytes()
        if len(word) <= self.LONGEST_KEPT:
            if len(self) >= self.limit:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return np.array(self._slow(text), dtype="<u4").tobytes()
        first, *words = text.split(" ")
        try:
            if not first or first[0].isspace() or first[-1].isspace():
                raise TypeError
            return np.array(self.piece(first), dtype="<u4").tobytes() + b"".join(map(self.__getitem__, words))
        except TypeError:
            return np.array(self.piece(text), dtype="<u4").tobytes()


class Levels:
    """Open windows by fill; `place` chooses one for an item by the sum-of-squares rule."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.gain = np.zeros(capacity + 1, dtype=np.int64)  # what leaving a level takes off the sum; far below 0 where no window is
        self.gain[1:] = -(1 << 40)
        self.cost = np.ones(capacity + 1, dtype=np.int64)  # what entering it adds
        self.cost[capacity] = 0
        self.open: list[list] = [[] for _ in range(capacity + 1)]
        self.held = 0  # ids in open windows

    def _shift(self, level: int, by: int) -> None:
        n = self.count[level] = self.count[level] + by
        self.gain[level] = 2 * n - 1 if n else -(1 << 40)
        self.cost[level] = 2 * n + 1
        self.held += by * level

    def put(self, fill: int, window: list) -> None:
        self.open[fill].append(window)
        self._shift(fill, 1)

    def drain(self) -> list[list[tuple]]:
        """All open windows, which are taken out."""
        windows = [window for level in self.open for window in level]
        self.__init__(self.capacity)
        return windows

    def place(self, size: int, piece: tuple) -> list | None:
        """The window, if it is now full."""
        level = int(np.argmax(self.gain[: self.capacity - size + 1] - self.cost[size:]))
        if level:
            window = self.open[level].pop()
            self._shift(level, -1)
        else:
            window = []
        window.append(piece)
        if level + size == self.capacity:
            return window
        self.put(level + size, window)
        return None


def _fill(window: list[tuple]) -> int:
    return sum(len(piece[2]) // 4 for piece in window)


def _pack(capacity: int, path: str, end_id: int, held: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, levels = None, Levels(capacity)
        sequence = TaskContext.get().partitionId() << 33
        end = np.array([end_id], dtype="<u4").tobytes()
        rows: list[tuple] = []

        def close(window: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, total, way in window:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, sequence, offset, way))
                offset += n
            sequence += 1

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            rows.clear()
            return out

        def topped_up(windows: list[list[tuple]]) -> list[tuple]:
            """Closes the fullest windows with what the least filled hold; the pieces that are left over."""
            left = deque(sorted(windows, key=_fill, reverse=True))
            spare: list[tuple] = []
            while left:
                window = left.popleft()
                gap = capacity - _fill(window)
                while gap and (spare or left):
                    spare = spare or left.pop()[::-1]
                    doc, start, ids, total, _ = spare.pop()
                    n = min(gap, len(ids) // 4)
                    window.append((doc, start, ids[: 4 * n], total, "cut"))
                    if 4 * n < len(ids):
                        spare.append((doc, start + n, ids[4 * n :], total, "cut"))
                    gap -= n
                if gap:
                    return window
                close(window)
            return spare[::-1]

        def ended(pieces: list[tuple]) -> None:
            """The last pieces, end to end, in runs of lengths that are powers of two."""
            left, room, window = _fill(pieces), 0, []
            for doc, start, ids, total, _ in pieces:
                while ids:
                    room = room or (capacity if left >= capacity else 1 << (left.bit_length() - 1))
                    n = min(room, len(ids) // 4)
                    window.append((doc, start, ids[: 4 * n], total, "cut"))
                    start, ids, room, left = start + n, ids[4 * n :], room - n, left - n
                    if not room:
                        close(window)
                        window = []

        for batch in batches:
            encoder = encoder or Encoder(path)
            for doc, text in zip(batch.doc_id, batch.text, strict=True):
                ids = encoder.encode(text or "") + end
                total = len(ids) // 4
                doc = None if pd.isna(doc) else doc
                full = total - total % capacity
                for start in range(0, full, capacity):
                    close([(doc, start, ids[4 * start : 4 * (start + capacity)], total, "full")])
                if full < total:
                    window = levels.place(total - full, (doc, full, ids[4 * full :], total, "rule"))
                    if window:
                        close(window)
                    elif levels.held > held:
                        left = topped_up(levels.drain())
                        if left:
                            levels.put(_fill(left), left)
                if len(rows) >= 20_000:
                    yield frame()
        ended(topped_up(levels.drain()))
        if rows:
            yield frame()

    return pack


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 1024, path: str | None = None, end_id: int = 0, held: int = 2_000_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, way.

    `way` is how a piece came to its place: a `full` window of one document, the `rule`, or `cut`
    to top up a window or to end the input.

    A null or empty text is the end id alone. Ids may be null or repeat: each row is a
    document of its own. Long texts are cut into full sequences as they come; other columns
    are not read. An empty table gives no pieces. At most `held` ids, and one text's, are kept
    in a task's memory. Sequence ids are unique over the table:
    the partition's number times 2^33, plus a count.
    """
    path = path or tokenizer_path()
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInPandas(_pack(capacity, path, end_id, held), PIECES)
