"""Cross-tokenizer alignment: where the tokens of two vocabularies end at the same byte.

Both tokenizers read a space and the text. The tokens of a whole Arrow batch are laid end to
end, so that a document is a stretch of bytes; the ends of A's and of B's tokens are counted
into bins once, and the stretch is cut where both occur. Every end of either kind closes one
overlap of an A token with a B token (a link), so prefix sums over the ends give each link's two
tokens, and prefix sums read at the documents' ends give each document's numbers.

How often two ids are linked is a count over the corpus. The pairs that are linked most often,
at most `common_pairs` of them, travel to the tasks as an array; a document's other links meet
their counts in a join, one row a document and pair. A pair that is not common has few links, so
that join has no hot key.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged
from .packing import Encoder, _bytes_of_symbols, tokenizer_path

#: Bytes whose ends are counted into bins at a time.
WINDOW = 1 << 20
#: Bytes of text in an Arrow batch: a batch's tokens, ends and links are in memory together.
BATCH_BYTES = 2 << 20


def byte_level_bytes(path: str) -> list[bytes]:
    """Each id's bytes in a byte-level vocabulary; ids that it lacks have none."""
    symbols = _bytes_of_symbols()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = b"".join(bytes([symbols[c]]) if c in symbols else c.encode() for c in token)
    return out


def piece_bytes(pieces) -> list[bytes]:
    """Each id's bytes: a byte piece's byte, else the piece with spaces for U+2581."""
    return [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, pieces.id_to_piece(i)) for i in range(pieces.get_piece_size()))]


class Both:
    """The ids of both tokenizers for whole texts, as little-endian uint32 bytes.

    Texts are cut before single spaces that have other signs on both sides. A's ids never join
    over such a place (see `Encoder`), nor do B's, if no piece of its vocabulary has a space
    after another sign; else texts are encoded whole. The words between are encoded once a batch
    and kept in bounded tables. A word or text whose tokens' bytes do not give it back has none.
    """

    IRREGULAR, PLACE = re.compile(r"^\s|\s$|\s | \s"), re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, a_path: str, b_path: str, limit: int = 200_000, signs: int = 8_000_000):
        import sentencepiece

        encoder = Encoder(a_path)
        encoder.whole.encode_special_tokens = True
        self.piece = encoder.piece
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes, self.b_bytes = byte_level_bytes(a_path), piece_bytes(self.pieces)
        self.a_len, self.b_len = (np.fromiter(map(len, x), dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        self.by_word = not any(b" " in p.lstrip(b" ") for p in self.b_bytes)
        self.limit, self.signs, self.held = limit, signs, 0
        self.a: dict[str, bytes] = {}
        self.b: dict[str, bytes] = {}

    def read(self, text: str) -> tuple[bytes, bytes] | None:
        a, b = self.piece(f" {text}"), self.pieces.encode(text)
        want = f" {text}".encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != want or b"".join(map(self.b_bytes.__getitem__, b)) != want:
            return None
        return np.array(a, dtype="<u4").tobytes(), np.array(b, dtype="<u4").tobytes()

    def _keep(self, word: str, ids: tuple[bytes, bytes] | None) -> None:
        if ids:
            self.a[word], self.b[word] = ids
            self.held += len(word)

    def learn(self, words: list[str]) -> None:
        """Encode words together: A's as one text, cut where words end."""
        whole = [w for w in words if w and not (w[0].isspace() or w[-1].isspace())]
        joined = f" {' '.join(whole)}"
        sizes = np.fromiter((len(w.encode()) + 1 for w in whole), dtype=np.int64, count=len(whole))
        a, b = self.piece(joined) if whole else [], self.pieces.encode(whole)
        flat = list(chain.from_iterable(b))
        ends = [np.cumsum(n[x]) for n, x in ((self.a_len, np.array(a, dtype=np.int64)), (self.b_len, np.array(flat, dtype=np.int64)))]
        stops = [np.searchsorted(e, np.cumsum(sizes)) + 1 for e in ends]
        raw = joined.encode() if whole else b""
        if all(b"".join(map(known.__getitem__, x)) == raw for known, x in ((self.a_bytes, a), (self.b_bytes, flat))) and np.array_equal(stops[1], np.cumsum(np.fromiter(map(len, b), dtype=np.int64, count=len(b)))):
            a_ids, b_ids = (np.array(x, dtype="<u4").tobytes() for x in (a, flat))
            a_stops, b_stops = ((4 * x).tolist() for x in stops)
            self.a.update(zip(whole, map(a_ids.__getitem__, map(slice, [0, *a_stops], a_stops)), strict=True))
            self.b.update(zip(whole, map(b_ids.__getitem__, map(slice, [0, *b_stops], b_stops)), strict=True))
            self.held += len(raw)
        else:
            for word in whole:
                self._keep(word, self.read(word))
        if len(whole) < len(words):
            for word in set(words).difference(whole):
                self._keep(word, self.read(word))

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Empty for a text that has no tokens or that one of the two does not give back."""
        if not self.by_word:
            found = [t and self.read(t) or (b"", b"") for t in texts]
            return [x for x, _ in found], [x for _, x in found]
        if len(self.a) > self.limit or self.held > self.signs:
            self.a.clear()
            self.b.clear()
            self.held = 0
        words = [(self.PLACE.split(t) if self.IRREGULAR.search(t) else t.split(" ")) if t else [] for t in texts]
        new = list(set(chain.from_iterable(words)).difference(self.a))
        for low in range(0, len(new), 4096):
            self.learn(new[low : low + 4096])
        a, b = [], []
        for own in words:
            try:
                ids = b"".join(map(self.a.__getitem__, own)), b"".join(map(self.b.__getitem__, own))
            except KeyError:  # a word that is not given back
                ids = b"", b""
            a.append(ids[0])
            b.append(ids[1])
        return a, b


def aligned(a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every end of a token, in order: its byte, whether A's ends there, B's, and so both (a cut).

    `a` and `b` are the ids of texts laid end to end, `a_len` and `b_len` the bytes of an id.
    """
    a_end, b_end = np.cumsum(a_len[a]), np.cumsum(b_len[b])
    total = int(a_end[-1]) if len(a_end) else 0
    at, in_a, in_b = [], [], []
    for low in range(1, total + 1, WINDOW):
        size = min(WINDOW, total + 1 - low)
        ends = [np.bincount(e[slice(*np.searchsorted(e, [low, low + size]))] - low, minlength=size) > 0 for e in (a_end, b_end)]
        here = np.flatnonzero(ends[0] | ends[1])
        at.append(here + low)
        in_a.append(ends[0][here])
        in_b.append(ends[1][here])
    if not at:
        none = np.zeros(0, dtype=bool)
        return np.zeros(0, dtype=np.int64), none, none, none
    at, in_a, in_b = np.concatenate(at), np.concatenate(in_a), np.concatenate(in_b)
    return at, in_a, in_b, in_a & in_b


def _before(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place."""
    return np.cumsum(flags) - flags


class _Texts:
    """Ids with the sign that follows them in a group's text, by 3 * id + sign."""

    COMMA, BAR, SEMICOLON = range(3)

    def __init__(self, ids: int):
        self.known = [b"%d%b" % (i, s) for i in range(ids) for s in (b",", b"|", b";")]

    def parts(self, a, b, in_a, in_b, cut) -> list[bytes]:
        """Of each token, group by group, A's before B's: its id and the sign that follows."""
        order = _before(cut)
        a_group, b_group = order[in_a], order[in_b]
        a_through = np.cumsum(in_a)[cut]  # A tokens up to each group's end
        b_before = np.concatenate([[0], np.cumsum(in_b)[cut]])
        code = np.empty(len(a) + len(b), dtype=np.int64)
        code[np.arange(len(a)) + b_before[a_group]] = a * 3 + np.where(cut[in_a], self.BAR, self.COMMA)
        code[np.arange(len(b)) + a_through[b_group]] = b * 3 + np.where(cut[in_b], self.SEMICOLON, self.COMMA)
        return list(map(self.known.__getitem__, code.tolist()))


ROWS = "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def _kind(a_size: int, b_size: int) -> str:
    """The width of an id pair's number."""
    return "<u4" if a_size * b_size <= 1 << 32 else "<u8"


def _align(a_path: str, b_path: str, with_groups: bool):
    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = None
        for batch in batches:
            if both is None:
                both = Both(a_path, b_path)
                a_len, b_len = both.a_len, both.b_len
                texts, kind = _Texts(max(len(a_len), len(b_len))), _kind(len(a_len), len(b_len))
            ids = both.encode(batch.text.tolist())
            a, b = (np.frombuffer(b"".join(x), dtype="<u4").astype(np.int64) for x in ids)
            n_a, n_b = (np.array([len(x) // 4 for x in side], dtype=np.int64) for side in ids)
            del ids
            at, in_a, in_b, cut = aligned(a, b, a_len, b_len)
            # prefix sums at the documents' ends; a document's last byte ends a token of each
            a_ends = np.concatenate([[0], np.cumsum(a_len[a])])
            last = np.searchsorted(at, a_ends[np.cumsum(n_a)], side="right")
            groups = np.diff(np.concatenate([[0], np.cumsum(cut)])[last], prepend=0)
            first = np.concatenate([[0], last[:-1]])
            key = (a[_before(in_a)] * len(b_len) + b[_before(in_b)]).astype(kind)
            parts = texts.parts(a, b, in_a, in_b, cut)
            stop = np.cumsum(n_a + n_b).tolist()
            start, sums, own = 0, [], []
            for end in stop:
                joined = b"".join(parts[start:end])[:-1]
                sums.append(hashlib.sha256(joined).hexdigest() if joined else "")
                own.append(joined.decode())
                start = end
            out = {
                "row_id": batch.row_id, "doc_id": batch.doc_id.astype("Int64"), "n_a": n_a, "n_b": n_b, "n_groups": groups, "n_links": last - first,
                "groups_sha256": sums, "links": [key[i:j].tobytes() for i, j in zip(first.tolist(), last.tolist(), strict=True)],
            }
            yield pd.DataFrame(out | ({"groups": own} if with_groups else {}))

    return align


def _tally(kind: str, held: int = 1 << 20):
    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links of each pair, added up over batches while at most about `held` pairs are known."""
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            links = b"".join(batch.links)
            if not links:
                continue
            more, n = np.unique(np.frombuffer(links, dtype=kind), return_counts=True)
            keys, where = np.unique(np.concatenate([keys, more.astype(np.int64)]), return_inverse=True)
            total = np.zeros(len(keys), dtype=np.int64)
            total[where[: len(counts)]] = counts
            total[where[len(counts) :]] += n
            counts = total
            if len(keys) > held:
                yield pd.DataFrame({"pair": keys, "n": counts})
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield pd.DataFrame({"pair": keys, "n": counts})

    return tally


def pair_counts(links: DataFrame, a_size: int, b_size: int) -> DataFrame:
    """(pair, n, best): links of each id pair over all rows, and whether that is its B id's largest count."""
    sums = staged(links.select("links").mapInPandas(_tally(_kind(a_size, b_size)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-sums")
    top = sums.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("n").alias("top"))
    out = staged(sums.join(top, F.col("pair") % b_size == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pair-counts")
    discard(sums)
    return out


def common(pairs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs, sorted, of at least so many links that at most `most` pairs have them; their links, whether they are best, and that limit."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = {r.level: r.n for r in pairs.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}  # at most 63 rows
    least, room = 64, most
    while least and (room := room - sizes.get(least - 1, 0)) >= 0:
        least -= 1
    rows = pairs.where(level >= least).toPandas().sort_values("pair")  # at most `most` rows of 17 bytes
    return rows.pair.to_numpy(), rows.n.to_numpy(), rows.best.to_numpy(), least


LOOKED_UP = "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<struct<pair:long,times:long>>"


def _look_up(shared, kind: str):
    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts, best = shared.value
        for batch in batches:
            key = np.frombuffer(b"".join(batch.links), dtype=kind).astype(np.int64)
            ends = np.cumsum(np.array([len(x) // int(kind[-1]) for x in batch.links], dtype=np.int64))
            part, where = np.unique(key, return_inverse=True)
            at = np.minimum(np.searchsorted(known, part), max(0, len(known) - 1))
            hit = known[at] == part if len(known) else np.zeros(len(part), dtype=bool)
            n = np.where(hit, counts[at], 0)[where] if len(known) else np.zeros(len(key), dtype=np.int64)
            is_best = (hit & best[at])[where] if len(known) else np.zeros(len(key), dtype=bool)
            sums, bests = (np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[ends], prepend=0) for x in (n, is_best))
            missed = np.flatnonzero(~hit[where])
            owner = np.searchsorted(ends, missed, side="right")
            rest: list[list] = [[] for _ in range(len(batch))]
            some, first = np.unique(owner, return_index=True)
            for doc, own in zip(some.tolist(), np.split(key[missed], first[1:]), strict=False):  # without a miss there is one empty part
                pairs, times = np.unique(own, return_counts=True)
                rest[doc] = [{"pair": p, "times": t} for p, t in zip(pairs.tolist(), times.tolist(), strict=True)]
            out = batch.drop(columns="links").assign(n_best=bests, count_sum=sums, rest=rest)
            yield out.assign(doc_id=out.doc_id.astype("Int64"))

    return look_up


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and groups, as `a1,a2|b1;a3|b2,b3`."""
    own = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    work = _align(a_path or tokenizer_path(), b_path or tokenizer_path("piece_bpe_32k.model"), True)
    return own.mapInPandas(work, ROWS + ", groups string").drop("row_id", "links")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, a_path: str | None = None, b_path: str | None = None, common_pairs: int = 1 << 20) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text that is null or empty, or that one tokenizer's bytes do not give back with a space
    before it, has no tokens: zeros and an empty digest. Ids may be null or repeat, as each row
    is a document of its own; repeated texts count as often as they occur. Other columns are not
    read. An empty table gives no rows. A task holds one Arrow batch of about 2 MB of text, or a
    longer text of its own, and `common_pairs` pairs with their counts.
    """
    a_path, b_path = a_path or tokenizer_path(), b_path or tokenizer_path("piece_bpe_32k.model")
    spark = docs.sparkSession
    import sentencepiece

    a_size, b_size = len(byte_level_bytes(a_path)), sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    own = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    links = staged(own.mapInPandas(_align(a_path, b_path, False), ROWS), "alignment", batch_bytes=BATCH_BYTES)
    pairs = pair_counts(links, a_size, b_size)
    *table, least = common(pairs, common_pairs)
    found = staged(links.mapInPandas(_look_up(spark.sparkContext.broadcast(tuple(table)), _kind(a_size, b_size)), LOOKED_UP), "alignment-sums", batch_bytes=4 * BATCH_BYTES)
    rare = pairs.where(F.floor(F.log2("n")) < least)
    rest = (
        found.where(F.size("rest") > 0)
        .select("row_id", F.explode("rest").alias("r"))
        .select("row_id", "r.pair", "r.times")
        .join(rare, "pair")
        .select("row_id", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    )
    slim = found.drop("rest")
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    both = slim.unionByName(rest, allowMissingColumns=True).groupBy("row_id").agg(*[F.max(c).alias(c) for c in ["doc_id", *numbers, "groups_sha256"]], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    discard(links)
    return both.select("doc_id", *numbers, "n_best", "count_sum", "groups_sha256")
