"""Toxicity through a noisy channel.

Written text is taken as clean text that passed a channel of leetspeak (``1d10t``),
spacing (``a s s``, ``i-d-i-o-t``) and repetition (``idiooot``, ``iddiioott``). A token that
shows such marks becomes a lattice of characters: each place lists what it may
stand for, with the channel's cost. A Viterbi search finds the cheapest path
under a character trigram model counted over the whole corpus; its words are the
restored text. Paths little dearer count where they yield a learned indicator.
Tokens without marks are their own restoration; digits alone are a number.

Restored words are scored by indicators: words and beginnings of words that
labelled toxic rows have and others do not, each with its log-odds; near copies
of a row count once, so that the other words of a text that was copied often are
not learned. A document's log-odds are calibrated from the sum over its distinct
indicators. The words learned also enter the character model.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import slices, texts_of, utf8_input
from shelfrank.llm.quality import held_out, sample, scored

#: Labelled rows of each class that are learned from, and the longest text
#: among them (bytes). Scoring has no limit of either kind.
TRAIN_ROWS = 1_500
TRAIN_BYTES = 30_000
#: Lengths (bytes) of word beginnings that can be indicators; toxic rows (near
#: copies once) an indicator must stand in, and share of toxic rows among those
#: that hold it.
HEADS = range(4, 10)
SUPPORT = 3
PURITY = 0.9
#: Distinct tokens whose restoration a task remembers.
MEMO_TOKENS = 200_000
#: The same on the driver, in training.
TRAIN_TOKENS = 50_000

# ------------------------------------------------------- character model

#: Symbols: 0 outside words, 1-26 a-z, 27 any byte of a non-ASCII character.
SYMBOLS = 28
_SYMBOL = bytes(b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 if b >= 0x80 else 0 for b in range(256))


def trigram_counts(utf8: bytes) -> np.ndarray:
    """Counts of symbol trigrams; what stands before a word is always 0, 0."""
    s = np.frombuffer(b"\0\0" + utf8.translate(_SYMBOL) + b"\0", np.uint8).astype(np.int32)
    a, b, c = np.where(s[1:-1] == 0, 0, s[:-2]), s[1:-1], s[2:]
    return np.bincount((a * SYMBOLS + b) * SYMBOLS + c, minlength=SYMBOLS ** 3)


def corpus_trigrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``trigram``, ``n`` over all documents. Each task sends one row for each
    trigram it met (at most SYMBOLS ** 3)."""
    def run(batches):
        total = np.zeros(SYMBOLS ** 3, np.int64)
        for batch in batches:
            for part in slices(batch):
                total += trigram_counts(b"\n".join(texts_of(part)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["trigram", "n"])

    source = utf8_input(docs.select(F.lit(0).alias("i"), F.col(text_col).alias("t")), "i", "t", False)
    return source.mapInArrow(run, "trigram int, n bigint").groupBy("trigram").agg(F.sum("n").alias("n"))


def costs(counts: np.ndarray) -> np.ndarray:
    """Negative log probability of each symbol after each two, smoothed with the
    bigram and those with the single symbol."""
    n = counts.reshape((SYMBOLS,) * 3).astype(float)
    one = (n.sum((0, 1)) + 1) / (n.sum() + SYMBOLS)
    pair = n.sum(0)
    two = (pair + 8 * one) / (pair.sum(1, keepdims=True) + 8)
    three = (n + 8 * two[None]) / (n.sum(2, keepdims=True) + 8)
    return -np.log(three)


# --------------------------------------------------------------- channel

#: What a sign may stand for (fixed values).
LEET = {
    b"0": b"o", b"1": b"il", b"2": b"z", b"3": b"e", b"4": b"a", b"5": b"s", b"6": b"gb", b"7": b"t", b"8": b"b", b"9": b"g",
    b"@": b"a", b"$": b"s", b"!": b"il", b"|": b"il", b"+": b"t", b"(": b"c", b"*": b"aeiou", b"#": b"h",
}
#: Costs: a sign read as a letter, a sign left out that is no letter or may be
#: one, a sign that may be a letter read as the end of a word, a gap left out, a
#: run made shorter.
READ, DROP, LOST, SPLIT, GAP, RUN = 1.0, 1.5, 6.0, 4.0, 0.2, 0.3
#: Cheapest paths looked at for indicators, and how much dearer than the first.
MOST, WITHIN = 4, 3.0
_KEYS = (1 << 61) - 1

_GAPS = b" \t\n.-_,~*"
_TRIM = b"".join(bytes([b]) for b in range(33, 127) if not bytes([b]).isalnum())
_MARKED = re.compile(rb"[a-z\x80-\xff].*[0-9@$!|+(*#._\-~].*|[0-9@$!|+(*#].*[a-z\x80-\xff].*|.*([a-z])\1")
#: Signs and digits that may all be letters; digits alone are a number.
_SIGNS_ONLY = re.compile(rb"(?=.*[@$!|+(*#])(?=(.).*(?!\1)[0-9@$!|+(*#])[0-9@$!|+(*#]{3,}$")
#: What may stand between letters: signs and white space, also spaces beyond ASCII
#: and those without a width, in any number and over line breaks.
_WIDE = rb"(?:[ \t\n\x0B-\r.\-_,~]|\xC2\xA0|\xE2\x80[\x80-\x8F\xA8\xA9\xAF]|\xE2\x81\xA0|\xEF\xBB\xBF)"
_SPACED = re.compile(rb"(?<![a-z0-9@$!|\x80-\xff])(?:[a-z0-9@$!|+(*#](?:" + _WIDE + rb"++|[ \t.\-_,~*]{1,3})){2,}[a-z0-9@$!|+(*#](?![a-z0-9\x80-\xff])")
#: Such a gap that is none of the short plain ones; it is read as one space.
_LONG_GAP = re.compile(rb"(?=" + _WIDE + rb"{4}|[ \t.\-_,~]*[\n\x0B-\r\x80-\xff])" + _WIDE + rb"++")
_RUN = re.compile(rb"([a-z])\1")
_RUNS = re.compile(rb"([a-z])\1+")
_SAME = re.compile(rb"(.)\1*")
#: Punctuation that stands for no letter.
_EDGE = bytes(b for b in _TRIM if bytes([b]) not in LEET)
_PLAIN = re.compile(rb"[a-z\x80-\xff]+")


def lattice(token: bytes) -> list[list[tuple[bytes, float]]]:
    """For each place what it may stand for, with its cost; an empty string for
    nothing, a space for the end of a word."""
    out = []
    at = 0
    while at < len(token):
        c = token[at:at + 1]
        end = at + 1
        while end < len(token) and token[end:end + 1] == c:
            end += 1
        n = end - at
        if c.isalpha() or c >= b"\x80":
            if n > 1 and c < b"\x80":
                out.append([(c, RUN), (c * 2, RUN if n > 2 else 0.0)])
            else:
                out += [[(c, 0.0)]] * n
        else:
            options = [(b"", GAP if c in _GAPS and n < 4 else LOST if c in LEET and n == 1 else DROP)]
            if c in b" \t\n":
                options.append((b" ", 0.0))
            elif c not in LEET or c in b"!|(*#+":
                options.append((b" ", READ if c not in LEET else SPLIT))
            options += [(bytes([x]), READ) for x in LEET.get(c, b"")]
            out.append(options)
            if n > 1 and c in LEET and c not in b"*#(":
                # a sign written twice is a doubled letter or one letter
                again = RUN if n == 2 else READ
                out += [[(b"", RUN), *[(bytes([x]), again) for x in LEET[c]]]] * min(n - 1, 2)
        at = end
    return out


def restorations(token: bytes, cost: np.ndarray | list[float], most: int = MOST, within: float = WITHIN) -> list[bytes]:
    """Texts of the cheapest paths through the token's lattice, cheapest first:
    at most ``most``, none dearer than the first by more than ``within``."""
    if isinstance(cost, np.ndarray):
        cost = cost.ravel().tolist()
    # of a path: what it has paid, a hash of its text, the text as a linked list
    best: dict[tuple[int, int], list[tuple]] = {(0, 0): [(0.0, 0, None)]}
    for options in [*lattice(token), [(b" ", 0.0)]]:
        new: dict[tuple[int, int], list[tuple]] = {}
        for (a, b), paths in best.items():
            for emitted, extra in options:
                p, q, more = a, b, extra
                for x in emitted:
                    s = _SYMBOL[x]
                    if s or q:
                        more += cost[(p * SYMBOLS + q) * SYMBOLS + s]
                    p, q = (q, s) if q and s else (0, s)
                into = new.setdefault((p, q), [])
                for paid, key, text in paths:
                    for x in emitted:
                        key, text = (key * 257 + x + 1) % _KEYS, (text, x)
                    into.append((paid + more, key, text))
        best = {at: _cheapest(paths, most) for at, paths in new.items()}
    out = _cheapest([x for paths in best.values() for x in paths], most)
    return [_unlinked(text) for paid, _, text in out if paid <= out[0][0] + within]


def _cheapest(paths: list[tuple], most: int) -> list[tuple]:
    """The ``most`` cheapest of different texts, in order."""
    if len(paths) > 1:
        if most == 1:
            return [min(paths, key=itemgetter(0))]
        texts: dict[int, tuple] = {}
        for path in sorted(paths, key=itemgetter(0)):
            texts.setdefault(path[1], path)
            if len(texts) == most:
                break
        return list(texts.values())
    return paths


def _unlinked(text) -> bytes:
    out = bytearray()
    while text:
        text, x = text
        out.append(x)
    return bytes(out[::-1])


def restore(token: bytes, cost: np.ndarray) -> bytes:
    """The cheapest path through the token's lattice."""
    return restorations(token, cost, 1)[0]


def _prefixes(word: bytes) -> list[bytes]:
    return [word + b" ", *[word[:n] for n in range(1, min(len(word), HEADS[-1]) + 1)]]


class Restorer:
    """Restored words of lower-cased text. The cheapest path is read always, the
    next ones only for words that hold an indicator (one of ``known``)."""

    def __init__(self, cost: np.ndarray, known: dict[bytes, float] | None = None):
        self.cost = cost.ravel().tolist()
        self.known = known or {}
        self.memo: dict[bytes, tuple[bytes, ...]] = {}
        self.single = {_RUNS.sub(rb"\1", h) for h in self.known}
        # one bit for each letter of each indicator without its runs; of each byte
        # the letters that it may be, and those that it may follow as nothing new
        spelled = sorted({h.rstrip() for h in self.single})
        letters = b"".join(spelled)
        self.first = sum(1 << at for at in itertools.accumulate(map(len, spelled[:-1]), initial=0)) if spelled else 0
        self.last = self.first >> 1 | (1 << len(letters) >> 1)
        self.steps = []
        for c in range(256):
            x = bytes([c])
            may = LEET.get(x, b"") + x
            step = sum(1 << at for at, letter in enumerate(letters) if letter in may)
            stay = step if x.isalpha() or c >= 0x80 else (1 << len(letters)) - 1
            self.steps.append((step, stay))

    def possible(self, token: bytes) -> bool:
        """Whether some path of the lattice may hold an indicator: its letters in
        order, each read from a letter or sign, with only signs and repeats of the
        letter between. No other token needs a search; one pass over the bytes."""
        state, first, last, steps = 0, self.first, self.last, self.steps
        for c in token:
            step, stay = steps[c]
            state = (state << 1 | first) & step | state & stay
            if state & last:
                return True
        return False

    def read(self, part: bytes) -> list[bytes]:
        if self.known and _PLAIN.fullmatch(part):
            # all readings are alike but for runs; most words are like no indicator
            if self.single.isdisjoint(_prefixes(_RUNS.sub(rb"\1", part))):
                return []
        first, *others = restorations(part, self.cost, MOST if self.known else 1)
        return first.split() + [w for text in others for w in text.split() if any(h in self.known for h in _heads(w))]

    def words(self, token: bytes) -> tuple[bytes, ...]:
        core = token.strip(_TRIM)
        lead, _, tail = token.partition(core) if core else (b"", b"", token)
        lead, tail = lead.lstrip(_EDGE), tail.strip(_EDGE) if not core else tail.rstrip(_EDGE)
        if core.isalpha() and not lead and not tail and not _RUN.search(core):
            return (core,)
        found = _PLAIN.findall(core)
        # the signs at the edges of a token, or the nearest runs of them, may be letters of it
        for before in {lead, *(lead[m.start():] for m in list(_SAME.finditer(lead))[-2:]), b""}:
            for after in {tail, *(tail[:m.end()] for m in list(_SAME.finditer(tail))[:2]), b""}:
                part = before + core + after
                if _MARKED.match(part) or _SIGNS_ONLY.match(part):
                    found += self.read(part)
        return tuple(dict.fromkeys(found))

    def spaced(self, low: bytes) -> list[bytes]:
        """Words restored from letters that stand apart."""
        return [w for m in _SPACED.finditer(low) for w in self.joined(_LONG_GAP.sub(b" ", m[0]))]

    def joined(self, apart: bytes) -> list[bytes]:
        return [w for w in self.read(apart) if len(w) > 2]


# ------------------------------------------------------------- indicators

def _heads(word: bytes) -> list[bytes]:
    """What of a word can be an indicator: the word (closed by a space) and its
    beginnings."""
    return [word + b" ", *[word[:n] for n in HEADS if n <= len(word)]]


@dataclass
class Model:
    """``weights`` of indicators; the log-odds of a document are ``bias`` plus
    ``scale`` times the sum over its distinct indicators."""

    cost: np.ndarray
    weights: dict[bytes, float]
    bias: float
    scale: float
    memo: dict = field(default_factory=dict)
    restorer: Restorer | None = None

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "restorer": None}

    def found(self, utf8: bytes) -> set[bytes]:
        """The document's indicators, in its restored text."""
        restorer = self.restorer = self.restorer or Restorer(self.cost, self.weights)
        low, memo, out = utf8.lower(), self.memo, set()
        apart = {b" " + _LONG_GAP.sub(b" ", m[0]) for m in _SPACED.finditer(low)}
        for token in {*low.split(), *apart}:
            hits = memo.get(token)
            if hits is None:
                if len(memo) >= MEMO_TOKENS:
                    memo.clear()
                words = () if not restorer.possible(token) else restorer.joined(token[1:]) if token in apart else restorer.words(token)
                hits = memo[token] = [h for w in words for h in _heads(w) if h in self.weights]
            if hits:
                out.update(hits)
        return out

    def logit(self, found: set[bytes]) -> float:
        # of a word and its beginnings only the strongest counts
        total = 0.0
        for h in found:
            if not any(h != o and h.startswith(o) and self.weights[o] >= self.weights[h] for o in found):
                total += self.weights[h]
        return self.bias + self.scale * total

    def score(self, utf8: bytes) -> float:
        return 1.0 / (1.0 + float(np.exp(-self.logit(self.found(utf8)))))


def _row_words(utf8: bytes, restorer: Restorer) -> set[bytes]:
    low = utf8.lower()
    out, memo = set(restorer.spaced(low)), restorer.memo
    for token in set(low.split()):
        words = memo.get(token)
        if words is None:
            if len(memo) >= TRAIN_TOKENS:
                memo.clear()
            words = memo[token] = restorer.words(token)
        out.update(words)
    return out


def _families(texts: list[bytes]) -> list[int]:
    """A number for each text that near copies share: texts whose shingles of
    five words have the same two smallest hashes, under any of four orders."""
    root = list(range(len(texts)))

    def top(r: int) -> int:
        while root[r] != r:
            root[r] = r = root[root[r]]
        return r

    met: dict[tuple, int] = {}
    for r, text in enumerate(texts):
        words = text.lower().split()
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words[i:i + 5])) for i in range(max(1, len(words) - 4))], np.uint64)
        for k in range(4):
            order = np.sort((h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & (1 << 64) - 1))
            root[top(r)] = top(met.setdefault((k, *order[:2].tolist()), r))
    return [top(r) for r in range(len(texts))]


def indicators(texts: list[bytes], labels: list[int], share: float, cost: np.ndarray) -> tuple[dict[bytes, float], list[bytes]]:
    """Indicators with their log-odds, and the whole words among them. Near
    copies count as one row."""
    restorer = Restorer(cost)
    rows = [_row_words(t, restorer) for t in texts]
    family = _families(texts)
    holders: dict[bytes, set[int]] = {}
    for row, y, f in zip(rows, labels, family):
        if y:
            for h in {h for w in row for h in _heads(w)}:
                holders.setdefault(h, set()).add(f)
    holders = {h: f for h, f in holders.items() if len(f) >= SUPPORT}
    clean: dict[bytes, set[int]] = {h: set() for h in holders}
    for row, y, f in zip(rows, labels, family):
        if not y:
            for h in {h for w in row for h in _heads(w)}:
                if h in clean:
                    clean[h].add(f)
    n_toxic = len({f for f, y in zip(family, labels) if y})
    n_clean = len({f for f, y in zip(family, labels) if not y})
    weights = {}
    for h, f in holders.items():
        # the sample's classes are drawn apart: compare rates, not counts
        toxic, other = (len(f) + 0.5) / (n_toxic + 1), (len(clean[h]) + 0.5) / (n_clean + 1)
        if toxic * share / (toxic * share + other * (1 - share)) >= PURITY:
            weights[h] = float(np.log(toxic / other))
    words = [h[:-1] for h in weights if h.endswith(b" ")]
    nested: dict[bytes, list[bytes]] = {}
    for h in weights:
        if not h.endswith(b" "):
            nested.setdefault(h[:-1], []).append(h)
    # of nested beginnings with one weight the longest stays, else the strongest
    kept = {}
    for h, x in weights.items():
        word = h.endswith(b" ")
        shorter = [weights.get(h[:n], -1.0) for n in HEADS if n < len(h)]
        longer = any(weights[o] >= x for o in nested.get(h, ()))
        if not longer and (max(shorter, default=-1.0) < x if word else max(shorter, default=-1.0) <= x):
            kept[h] = x
    return kept, words


def train(texts: list[bytes], labels: list[int], share: float, counts: np.ndarray) -> Model:
    """Chooses and weighs the indicators under the character model of ``counts``,
    then calibrates the sum so that the score is a probability for rows as they come (``share`` of them toxic)."""
    _, words = indicators(texts, labels, share, costs(counts))
    # the channel's source also writes the words that were learned
    counts = counts.copy()
    often = max(1, counts.sum() // 2000)
    for w in words:
        counts += often * trigram_counts(w)
    cost = costs(counts)
    weights, _ = indicators(texts, labels, share, cost)
    n_toxic, prior = sum(labels), float(np.log(share / (1 - share)))
    n_clean = len(labels) - n_toxic
    model = Model(cost, weights, 0.0, 1.0)
    x = np.array([model.logit(model.found(t)) for t in texts])
    y = np.array(labels, float)
    weight = np.where(y > 0, share / max(1, n_toxic), (1 - share) / max(1, n_clean))
    bias, scale = prior, 0.0
    for _ in range(50):  # Newton steps of a logistic regression on the sum, slightly damped
        p = 1 / (1 + np.exp(-(bias + scale * x)))
        g = np.array([(weight * (p - y)).sum(), (weight * (p - y) * x).sum() + 1e-4 * scale])
        v = weight * p * (1 - p)
        hess = np.array([[v.sum() + 1e-6, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1e-4]])
        step = np.linalg.solve(hess, g)
        bias, scale = bias - float(step[0]), scale - float(step[1])
        if np.abs(step).max() < 1e-8:
            break
    model.bias, model.scale = bias, max(scale, 0.0)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", train_rows: int = TRAIN_ROWS,
             train_bytes: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id``, ``held_out``, ``score`` (probability of label 1).

    The character model counts every document. Labels are learned from at most
    ``train_rows`` labelled documents of each class that are not held out and
    have at most ``train_bytes`` of text. Null and empty texts have no
    indicators and get the score of a text without any; without labels of both
    classes all scores are the share of label 1. One row per input row.
    """
    counts = np.zeros(SYMBOLS ** 3, np.int64)
    for r in corpus_trigrams(docs, text_col).collect():
        counts[r.trigram] = r.n
    texts, known, share = sample(docs, labels, label, rows=train_rows, most_bytes=train_bytes, id_col=id_col, text_col=text_col)
    if 0 < sum(known) < len(known):
        model = train(texts, known, share, counts)
    else:
        model = Model(costs(counts), {}, float(np.log(share / (1 - share))), 1.0)
    return scored(docs, model, id_col=id_col, text_col=text_col).select("id", held_out("id").alias("held_out"), "score")
