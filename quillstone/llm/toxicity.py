"""Toxicity of deobfuscated text: a noisy channel, decoded by Viterbi, then a lexicon model.

Channel: a writer's letters reach us changed. A digit or symbol may stand for a letter it looks
like, a letter may be repeated, and letters may be set apart by spaces or marks. A suspicious
token, or a run of single letters, is a lattice: each observed character offers the letters it
may stand for, itself, or nothing (a repetition or a mark). The Viterbi path under a character
4-gram model of the whole corpus is the restored text.

Scores come from a weighted lexicon of restored words and of beginnings of words, chosen and
weighted (logistic regression) on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .training import is_held_out, sample

#: Letters that a character is used for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou", "#": "h", "£": "l",
}
MARKS = set(" .-_*~'`/\\,:;|+^=")

#: Slots of the hashed counters by which terms are first weeded.
SLOTS = 1 << 20
SYMBOLS = 32
ORDER = 4
_EDGE, _OTHER, _DIGIT = 0, 27, 28


def _byte_classes() -> np.ndarray:
    """Class of each byte of lower-cased UTF-8: letters, digits, beyond ASCII, or a word's edge."""
    out = np.full(256, _EDGE, dtype=np.int32)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    out[ord("0") : ord("9") + 1] = _DIGIT
    out[128:] = _OTHER
    return out


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Character 4-grams of whole texts: (gram, n), one row a gram and task."""
    classes, total = _byte_classes(), np.zeros(SYMBOLS**ORDER, dtype=np.int64)

    def add(chunk: list[bytes]) -> None:
        nonlocal total
        c = classes[np.frombuffer(b"   " + b"   ".join(chunk) + b" ", dtype=np.uint8)]
        total += np.bincount(((c[:-3] * SYMBOLS + c[1:-2]) * SYMBOLS + c[2:-1]) * SYMBOLS + c[3:], minlength=len(total))

    for batch in batches:
        chunk, held = [], 0
        for text in batch.text:
            if text:
                chunk.append(text.encode("utf-8", "replace").lower())
                held += len(chunk[-1])
            if held > 2_000_000:
                add(chunk)
                chunk, held = [], 0
        if chunk:
            add(chunk)
    grams = np.flatnonzero(total)
    yield pd.DataFrame({"gram": grams, "n": total[grams]})


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(character | three before it) from all documents, as float32 of 32^4 entries.

    The counts are summed by Spark; what the driver gets has one size whatever the corpus.
    """
    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(_tally, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    full = np.zeros(SYMBOLS**ORDER)
    full[counted.gram.to_numpy(dtype=np.int64)] = counted.n.to_numpy(dtype=float)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for n in range(1, ORDER + 1):
        counts = full.reshape(-1, SYMBOLS**n).sum(axis=0).reshape(-1, SYMBOLS)
        kinds = np.maximum(1, (counts > 0).sum(axis=1, keepdims=True))
        p = (counts + kinds * np.tile(p.reshape(-1, SYMBOLS), (counts.shape[0] // max(1, p.size // SYMBOLS), 1))) / (counts.sum(axis=1, keepdims=True) + kinds)
    return np.log(p).astype(np.float32).ravel()


def _class_of(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    if c.isdigit():
        return _DIGIT
    return _OTHER if c.isalpha() else _EDGE


class Channel:
    """Viterbi decoding of character lattices; a state is the three classes emitted last and the last letter."""

    SUBSTITUTE, KEEP_MARK, DROP_MARK, DROP_DOUBLE, DROP_REPEAT = -1.2, -2.0, -0.4, -2.0, -0.2

    def __init__(self, logp: np.ndarray):
        self.logp = array("f", np.asarray(logp, dtype=np.float32).tobytes())  # yields plain floats
        self.offers: dict[tuple[str, int, bool], list[tuple[str, float, int]]] = {}

    def options(self, c: str, before: str, spelt: bool) -> list[tuple[str, float]]:
        found = [(c, self.KEEP_MARK if c in MARKS else 0.0)]
        looks = LOOKALIKES.get(c, "")
        if spelt and looks and not c.isdigit():
            found = []
        found += [(x, self.SUBSTITUTE - (1.0 if c == "*" else 0.0)) for x in looks]
        if c in MARKS and found[0][0] == c:
            found.append(("", self.DROP_MARK))
        if before.endswith(c) and c.isalpha():
            found.append(("", self.DROP_REPEAT if before.endswith(c + c) else self.DROP_DOUBLE))
        return found

    def offered(self, c: str, before: str, spelt: bool) -> list[tuple[str, float, int]]:
        """The options with their classes, looked up by the character and how often it stands before."""
        key = (c, 2 if before == c + c else 1 if before.endswith(c) else 0, spelt)
        if (found := self.offers.get(key)) is None:
            if len(self.offers) > 10_000:
                self.offers.clear()
            found = self.offers[key] = [(out, cost, _class_of(out) if out else _EDGE) for out, cost in self.options(c, before, spelt)]
        return found

    def decode(self, observed: str, *, spelt: bool = False) -> str:
        """The likeliest text, which ends a word; if `spelt`, every sign that looks like a letter is one."""
        logp, mask = self.logp, SYMBOLS ** (ORDER - 1)
        states: dict[tuple[int, str], tuple[float, tuple]] = {(0, ""): (0.0, ())}
        before = ""
        for c in [*observed, ""]:
            after: dict[tuple[int, str], tuple[float, tuple]] = {}
            offered, looks = self.offered(c, before, spelt) if c else [(" ", 0.0, _EDGE)], LOOKALIKES.get(c, "")
            for state, (score, path) in states.items():
                context, last = state
                offers = offered
                if looks and last and last in looks and not before.endswith(last):
                    offers = [*offered, ("", self.DROP_DOUBLE, _EDGE)]
                for out, cost, k in offers:
                    if not out or k == _EDGE and context % SYMBOLS == _EDGE:
                        key, value, way = state, score + cost, path
                    else:
                        gram = context * SYMBOLS + k
                        key, value, way = (gram % mask, out), score + cost + logp[gram], (path, out)
                    if (held := after.get(key)) is None or value > held[0]:
                        after[key] = (value, way)
            states, before = after, before[-1:] + c
        path, out = max(states.values(), key=lambda s: s[0])[1], []
        while path:
            path, letter = path
            out.append(letter)
        return "".join(reversed(out)).strip()


_LETTER = re.compile(r"[^\W\d_]")
_LOOKS = re.compile(f"[{re.escape(''.join(LOOKALIKES))}]")
_SIGN = re.compile(f"[{re.escape(''.join(c for c in LOOKALIKES if not c.isdigit()))}]")
_MARKED = re.compile(rf"[^\W\d_][{re.escape(''.join(MARKS))}]+[^\W\d_]")
_DRAWN = re.compile(r"([a-z])\1\1|([a-z])\2.*([a-z])\3")
_DOUBLED = re.compile(r"([^\W\d_])\1+")
_PLAIN = re.compile(r"([^\W\d_]+)[.,;:?]*")
_APART = re.compile(r"^[^\W_](?:[^\w]+|_+)(?:[^\W_](?:[^\w]+|_+)){1,}[^\W_]$")
_EDGES = ".,;:?!\"')]}>%&#*"
_STRETCHED = re.compile(r"(.)\1{2,}", re.DOTALL)
#: Marks that do not stand for letters part a token into pieces.
_PARTS = re.compile(f"[{re.escape(''.join(MARKS - set(LOOKALIKES)))}]+")
#: Longer texts are decoded in chunks that overlap; longer tokens are not looked up again.
CHUNK, OVERLAP, LONGEST_KEPT = 4096, 64, 200


def suspicious(token: str) -> bool:
    """Whether a lower-case token is worth a lattice: letters with what may stand for letters, marks
    between them or letters drawn out; or, without a letter, more than one such sign. Bare numbers are not."""
    if len(token) < 2:
        return False
    if _LETTER.search(token):
        return bool(_LOOKS.search(token) or _MARKED.search(token) or _DRAWN.search(token) or _APART.match(token))
    return bool(_SIGN.search(token)) and len(set(_LOOKS.findall(token))) > 1 or bool(_APART.match(token))


def is_single(token: str) -> bool:
    """A letter by itself, or what may stand for one."""
    return len(token) <= 2 and len(token.strip(_EDGES)) == 1 or token in LOOKALIKES


def spaced_words(tokens: list[str], at: list[int], channel: Channel) -> list[str]:
    """Words that runs of single letters restore to; `at` are the places of single letters, in order."""
    out: list[str] = []
    run: list[int] = []
    for i in [*at, -2]:
        if run and i != run[-1] + 1:
            if len(run) >= 3:
                letters = [tokens[j].strip(_EDGES) or tokens[j] for j in run]
                if any(x in LOOKALIKES or _LETTER.match(x) for x in letters):
                    out += _runs([x for k, x in enumerate(letters) if k < 2 or letters[k - 2 : k] != [x, x]], channel)
            run = []
        run.append(i)
    return out


def _runs(letters: list[str], channel: Channel) -> list[str]:
    out: list[str] = []
    for start in range(0, len(letters), CHUNK):
        run = " ".join(letters[max(0, start - OVERLAP) : start + CHUNK])
        for spelt in (False, True) if _SIGN.search(run) else (False,):
            out += [w for w in re.findall(r"[^\W_]+", channel.decode(run, spelt=spelt)) if not spelt or w not in out]
    return out


def readings(token: str, channel: Channel) -> Iterator[str]:
    """The words of a token of any length, decoded, and those with every sign inside it as a letter."""
    signs = token.rstrip(_EDGES)
    for text, spelt in ((token, False), (signs, True)) if _SIGN.search(signs) else ((token, False),):
        for start in range(0, len(text), CHUNK):
            yield from re.findall(r"[^\W_]+", channel.decode(text[max(0, start - OVERLAP) : start + CHUNK], spelt=spelt))


_PIECE = re.compile(r"[a-z0-9@$!|]{1,4}")
#: Log probability a character under which a short token is unusual as a word.
UNUSUAL = -3.2


def piece(token: str, channel: Channel) -> int:
    """1 for a short token that may be a part of a word, 2 if it is also unusual as a word by itself, else 0."""
    if len(token) > 4 or not _PIECE.fullmatch(token) or not _LETTER.search(token):
        return 0
    context, score = 0, 0.0
    for c in f"{token} ":
        gram = context * SYMBOLS + _class_of(c)
        score, context = score + channel.logp[gram], gram % SYMBOLS ** (ORDER - 1)
    return 2 if score < UNUSUAL * (len(token) + 1) else 1


def joined(a: str, b: str, channel: Channel) -> str:
    """The word that two tokens restore to if the likeliest way drops the space between them, else nothing."""
    text = channel.decode(f"{a} {b}")
    return text if text.isalpha() else ""


#: Words longer than this are not looked for across spaces.
LONGEST_WORD = 40
#: Least weight, with its beginnings, of a word of the lexicon that is looked for across spaces.
KNOWN = 0.25
_FOLD = str.maketrans({c: letters[0] for c, letters in LOOKALIKES.items()})


def folded(token: str) -> str:
    """A token's likeliest letters, each once in a row: what tells which pieces may make a known word."""
    core = token.strip(_EDGES)
    return _DOUBLED.sub(r"\1", core if core.isalpha() else core.translate(_FOLD))


class Pieces:
    """Known words that spaces cut into any number of pieces of any length.

    Neighbouring tokens are walked as long as their folded letters begin a known word. Where they make
    one, the tokens with their spaces are a lattice, and the word counts if the likeliest way through it
    is that word, without a space. One piece at least must not be a usual word by itself.
    """

    def __init__(self, words: Iterator[str] | list[str], usual: np.ndarray, channel: Channel):
        self.whole = {folded(w) for w in words if len(w) <= LONGEST_WORD and w.isalpha()}
        self.starts = {w[:n] for w in self.whole for n in range(1, len(w))}
        self.usual, self.channel, self.known, self.folds = usual, channel, {}, {}

    def fold(self, token: str) -> str:
        """A token's folded letters, looked up; a longer token is no piece."""
        if (letters := self.folds.get(token)) is None:
            if len(token) > LONGEST_KEPT:
                return ""
            if len(self.folds) >= 250_000:
                self.folds.clear()
            letters = self.folds[token] = folded(token)
        return letters

    def is_usual(self, token: str) -> bool:
        return bool(self.usual[_slot(token.strip(_EDGES))])

    def begins(self, token: str) -> bool:
        head = token[:3]
        if head not in self.starts and len(head) == 3 and head.isalpha() and head[0] != head[1] != head[2]:
            return False  # three letters that fold to themselves, and no word begins so
        return self.fold(token) in self.starts

    def ends(self, tokens: list[str], i: int) -> Iterator[int]:
        """The last places of tokens that, from place i on, make a known word; every step adds letters."""
        letters = self.fold(tokens[i])
        for j in range(i + 1, len(tokens)):
            more = self.fold(tokens[j])
            more = more[1:] if more[:1] == letters[-1:] else more
            if not more:
                return
            letters += more
            if letters in self.whole:
                yield j
            if letters not in self.starts:
                return

    def restored(self, pieces: list[str]) -> str:
        """The word that the pieces are, or nothing."""
        text = " ".join(pieces).strip(_EDGES)
        if (word := self.known.get(text)) is None:
            word = self.channel.decode(text) if not all(map(self.is_usual, pieces)) else ""
            word = word if word.isalpha() and folded(word) in self.whole else ""
            if len(text) <= LONGEST_KEPT:
                if len(self.known) >= 100_000:
                    self.known.clear()
                self.known[text] = word
        return word

    def words(self, tokens: list[str], at: list[int]) -> list[str]:
        """Restored words from the places `at`, where tokens begin one; runs of single letters are left out."""
        out, done = [], -1
        for i in at:
            if i <= done or i + 1 == len(tokens):
                continue
            first, second = self.fold(tokens[i]), self.fold(tokens[i + 1])
            both = first + (second[1:] if second[:1] == first[-1:] else second)
            if both not in self.starts and both not in self.whole:
                continue
            for j in self.ends(tokens, i):
                if not all(map(is_single, tokens[i : j + 1])) and (word := self.restored(tokens[i : j + 1])):
                    out.append(word)
                    done = j
        return out


def _slot(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "replace")) % SLOTS


def restored_words(text: str | None, known: Restorer) -> Counter:
    """A text's words, counted, with those that its tokens, its runs of letters and neighbouring pieces restore to."""
    tokens = text.lower().split() if text else []
    out = Counter(w for words in map(known.__getitem__, tokens) for w in words)
    out.update(spaced_words(tokens, [i for i, t in enumerate(tokens) if is_single(t)], known.channel))
    pieces = [piece(t, known.channel) for t in tokens]
    out.update(w for i in range(len(tokens) - 1) if pieces[i] and pieces[i + 1] and (pieces[i] | pieces[i + 1]) & 2 and (w := joined(tokens[i], tokens[i + 1], known.channel)))
    return out


class Restorer(dict):
    """Restored words of a token, looked up; decoded where suspicious."""

    def __init__(self, channel: Channel, limit: int = 300_000):
        super().__init__()
        self.channel, self.limit = channel, limit

    def words(self, token: str) -> tuple[str, ...]:
        """A plain word with marks after it takes the short way; it is drawn out only if letters double."""
        if (m := _PLAIN.fullmatch(token)) and not _DOUBLED.search(token):
            return (m[1],)
        core = token.strip(_EDGES)
        plain = tuple(re.findall(r"[^\W_]+", core))
        # one mark or one doubled letter needs no lattice: the shorter reading is offered too
        if len(plain) > 1:
            plain += ("".join(plain),)
        if (single := _DOUBLED.sub(r"\1", plain[-1] if plain else "")) != (plain[-1] if plain else ""):
            plain += (single,)
        whole = token.rstrip(".,;:?\"')")
        parts = [x for x in _PARTS.split(core) if x]
        back: dict[str, None] = {}
        for t in dict.fromkeys((core, whole, *(parts if len(parts) > 1 else ()))):
            if suspicious(t):
                back.update(dict.fromkeys(readings(_STRETCHED.sub(r"\1\1", t), self.channel)))
        if back:
            had = set(plain)
            plain += tuple(w for w in back if w not in had)
        return plain

    def __missing__(self, token: str) -> tuple[str, ...]:
        words = self.words(token)
        if len(token) <= LONGEST_KEPT:
            if len(self) >= self.limit:
                self.clear()
            self[token] = words
        return words


def _beginnings(word: str, shortest: int = 4, longest: int = 8) -> list[str]:
    return [word, *(word[:n] + "~" for n in range(shortest, min(longest, len(word)) + 1))]


def _word_counts(shared):
    @F.pandas_udf("words array<string>, counts array<int>")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        channel = Channel(shared.value)
        known = Restorer(channel)
        for batch in texts:
            out = []
            for text in batch:
                c = restored_words(text, known)
                out.append((list(c.keys()), list(c.values())))
            yield pd.DataFrame(out, columns=["words", "counts"])

    return count


@dataclass
class Lexicon:
    weights: dict[str, float]  # of words and of beginnings (with ~)
    bias: float
    length: float  # of log(1 + words)
    usual: np.ndarray | None = None  # bits of hashed words that several labelled texts have

    def words(self) -> list[str]:
        """Words that weigh for label 1 by themselves and their beginnings."""
        return [w for w in self.weights if not w.endswith("~") and sum(self.weights.get(t, 0.0) for t in _beginnings(w)) >= KNOWN]


def _contrast(one: np.ndarray, zero: np.ndarray, total: list[float]) -> np.ndarray:
    """How far a term's share of documents differs between the classes, in size and ratio."""
    a, b = (one + 0.5) / (total[1] + 1), (zero + 0.5) / (total[0] + 1)
    return np.abs(a - b) * np.abs(np.log(a / b))


#: Labelled texts that a usual word is in.
USUAL = 3


def train(rows: list[tuple[list[str], np.ndarray, int, float]], *, terms: int = 4000, least: int = 3, penalty: float = 0.3, steps: int = 400) -> Lexicon:
    """rows: a document's distinct restored words, their counts, the label and the row's weight.

    A term is in at least `least` of the rows. Terms are counted in hashed slots first; only those
    in the slots with most contrast are then counted by name, so memory does not grow with the vocabulary.
    """
    if not any(y for *_, y, _ in rows) or all(y for *_, y, _ in rows):
        rate = 0.5 if not rows else (1e-3 if not rows[0][2] else 1 - 1e-3)
        return Lexicon({}, float(np.log(rate / (1 - rate))), 0.0)
    total = [sum(w for *_, y, w in rows if y == k) for k in (0, 1)]
    slots: dict[str, np.ndarray] = {}

    def slots_of(word: str) -> np.ndarray:
        if (s := slots.get(word)) is None:
            if len(slots) > 200_000:
                slots.clear()
            s = slots[word] = np.array([_slot(t) for t in _beginnings(word)], dtype=np.int64)
        return s

    seen, often = np.zeros((2, SLOTS)), np.zeros(SLOTS)
    for words, _, y, w in rows:
        if words:
            at = np.unique(np.concatenate([slots_of(word) for word in words]))
            seen[y, at] += w
            often[at] += 1
    worth = np.where(often >= least, _contrast(seen[1], seen[0], total), 0)
    wanted = np.zeros(SLOTS, dtype=bool)
    wanted[np.argsort(-worth, kind="stable")[: 4 * terms]] = True
    wanted &= worth > 0
    named: tuple[Counter, Counter, Counter] = (Counter(), Counter(), Counter())
    docs = []
    for words, counts, y, w in rows:
        c: Counter = Counter()
        for word, n in zip(words, counts.tolist(), strict=True):
            if wanted[slots_of(word)].any():
                for t, s in zip(_beginnings(word), slots_of(word).tolist(), strict=True):
                    if wanted[s]:
                        c[t] += n
        docs.append(c)
        for t in c:
            named[y][t] += w
            named[2][t] += 1
    names = sorted(t for t, n in named[2].items() if n >= least)
    strength = _contrast(np.array([named[1][t] for t in names], dtype=float), np.array([named[0][t] for t in names], dtype=float), total)
    chosen = [names[i] for i in np.argsort(-strength, kind="stable")[:terms]]
    number = {t: i for i, t in enumerate(chosen)}
    entries = [(i, number[t], np.log1p(n)) for i, c in enumerate(docs) for t, n in c.items() if t in number]
    at, col, val = (np.array([e[k] for e in entries], dtype=kind) for k, kind in enumerate((np.int64, np.int64, float)))
    size = np.array([np.log1p(counts.sum()) for _, counts, _, _ in rows])
    y, weight = np.array([y for *_, y, _ in rows], dtype=float), np.array([w for *_, w in rows])
    weight = weight / weight.sum()
    theta = np.zeros(len(chosen) + 2)
    theta[-2] = np.log(total[1] / total[0])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = theta[-2] + theta[-1] * size + np.bincount(at, weights=val * theta[col], minlength=len(docs))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = np.r_[np.bincount(col, weights=val * g[at], minlength=len(chosen)) + penalty * theta[:-2] / len(docs), g.sum(), (g * size).sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    weights = {t: float(theta[i]) for t, i in number.items() if abs(theta[i]) > 1e-3}
    return Lexicon(weights, float(theta[-2]), float(theta[-1]), np.packbits(often >= USUAL))


class _Marks(dict):
    """Of a token, one number: the words it restores to, whether it is a single letter, and which terms it has.

    Bits 0 to 23 count words, bit 24 marks single letters, bits 25 and 26 are what `piece` gives,
    bit 27 marks what begins a known word across spaces, and what is above is the place of the token's terms in `lists`; place 0 is no terms, as almost
    all tokens have. `pairs` holds what neighbouring pieces restore to.
    """

    def __init__(self, restorer: Restorer, weights: dict[str, float], across: Pieces, limit: int = 250_000):
        super().__init__()
        self.restorer, self.weights, self.across, self.limit = restorer, weights, across, limit
        self.starts = {t[:4] for t in weights}  # a word with any term begins like one
        self.lists: list[tuple[str, ...]] = [()]
        self.places: dict[tuple[str, ...], int] = {(): 0}
        self.pairs: dict[tuple[str, str], str] = {}

    def pair(self, a: str, b: str) -> str:
        if (word := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= self.limit:
                self.pairs.clear()
            word = self.pairs[a, b] = joined(a, b, self.restorer.channel)
        return word

    def renew(self) -> None:
        """Starts anew between texts, so that what a text's numbers point to stays while it is scored."""
        if len(self) >= self.limit:
            self.clear()
            self.lists, self.places = [()], {(): 0}

    def terms(self, words: list[str] | tuple[str, ...]) -> tuple[str, ...]:
        return tuple(t for w in words if w[:4] in self.starts for t in _beginnings(w) if t in self.weights)

    def __missing__(self, token: str) -> int:
        words = self.restorer.words(token)
        found = self.terms(words)
        if found not in self.places:
            self.places[found] = len(self.lists)
            self.lists.append(found)
        value = min(len(words), (1 << 24) - 1) | is_single(token) << 24 | piece(token, self.restorer.channel) << 25 | self.across.begins(token) << 27 | self.places[found] << 28
        if len(token) <= LONGEST_KEPT:
            self[token] = value
        return value


def _scorer(shared):
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        logp, weights, bias, length, known, usual = shared.value
        channel = Channel(logp)
        across = Pieces(known, np.unpackbits(usual), channel)
        marks = _Marks(Restorer(channel), weights, across)

        def value(text: str | None) -> float:
            marks.renew()
            tokens = text.lower().split() if text else []
            m = np.fromiter(map(marks.__getitem__, tokens), dtype=np.int64, count=len(tokens))
            n, seen = int((m & (1 << 24) - 1).sum()), Counter()
            places = m >> 28
            for place, times in zip(*np.unique(places[places > 0], return_counts=True), strict=True):
                for t in marks.lists[place]:
                    seen[t] += int(times)
            at = np.flatnonzero(m & 1 << 24)
            if len(at) >= 3:
                words = spaced_words(tokens, at.tolist(), channel)
                n += len(words)
                seen.update(marks.terms(words))
            pieces = m >> 25 & 3
            for i in np.flatnonzero((pieces[:-1] > 0) & (pieces[1:] > 0) & ((pieces[:-1] | pieces[1:]) > 1)).tolist():
                if word := marks.pair(tokens[i], tokens[i + 1]):
                    n += 1
                    seen.update(marks.terms([word]))
            if words := across.words(tokens, np.flatnonzero(m & 1 << 27).tolist()):
                n += len(words)
                seen.update(marks.terms(words))
            return bias + length * float(np.log1p(n)) + sum(weights[t] * float(np.log1p(k)) for t, k in seen.items())

        for batch in texts:
            z = np.array([value(t) for t in batch], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -60, 60))))

    return score


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", *, max_rows: int = 2000, logp: np.ndarray | None = None, **options) -> tuple[np.ndarray, Lexicon]:
    """The character model of all documents, and a lexicon learned from at most about `max_rows`
    labelled rows of each class, none of them held out."""
    logp = character_model(docs) if logp is None else logp
    shared = docs.sparkSession.sparkContext.broadcast(logp)
    chosen = sample(docs, labels, label_col, max_rows=max_rows)
    rows = chosen.withColumn("w", _word_counts(shared)("text")).select("id", "label", "weight", "w.words", "w.counts")
    found = [(r.id, [sys.intern(w) for w in r.words], np.array(r["counts"], dtype=np.int32), r.label, r.weight) for r in rows.toLocalIterator()]
    found.sort(key=lambda r: r[0])
    return logp, train([r[1:] for r in found], **options)


def scored(docs: DataFrame, model: tuple[np.ndarray, Lexicon], text_col: str = "text", result: str = "_score") -> DataFrame:
    """`docs` with each whole text's probability of label 1; null and empty texts get the bias alone."""
    logp, lexicon = model
    usual = np.zeros(SLOTS // 8, dtype=np.uint8) if lexicon.usual is None else lexicon.usual
    shared = docs.sparkSession.sparkContext.broadcast((logp, lexicon.weights, lexicon.bias, lexicon.length, lexicon.words(), usual))
    return docs.withColumn(result, _scorer(shared)(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; repeated rows stay repeated.

    Labels, language, source and id are not inputs of a score; other columns are not read.
    Without labels every score is 0.5.
    """
    own = docs.select("doc_id", "text")
    result = scored(own, fit(own, labels, **options))
    return result.select("doc_id", is_held_out("doc_id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))
