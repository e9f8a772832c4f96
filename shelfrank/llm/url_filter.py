"""URL filters: glob rules as one bit-parallel automaton.

Every rule is a glob over a canonical URL (the host behind a dot, an end-of-host
sign, the path). All globs together are one Shift-And automaton: a bit for each
place of each glob, packed into as many 64-bit words as needed. One step per
character moves all bits of all rules at once,

    state = ((state << 1) & takes[c]) | (state & stays[c])

where ``takes[c]`` holds the places whose sign takes character c and ``stays[c]``
the places in front of a ``*``. Numpy steps the states of a whole batch of URLs
together. A rule fits where its last bit is set at the end of the URL.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import id_type

#: Codes beyond bytes: end of the host, end of the URL.
_HOST_END, _END = 256, 257
_ANY, _STAR = -1, -2


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def signs(self) -> list[int]:
        return [_STAR, ord("."), *self.host.encode(), _HOST_END, *self.path.encode(), _STAR]


@dataclass(frozen=True)
class Glob:
    """``*`` (any run) and ``?`` (any byte) over the host or over the path."""

    verdict: str
    pattern: str
    over: str = "host"

    @property
    def name(self) -> str:
        return self.pattern

    def signs(self) -> list[int]:
        body = [_STAR if c == 0x2A else _ANY if c == 0x3F else c for c in self.pattern.encode()]
        return [ord("."), *body, _HOST_END, _STAR] if self.over == "host" else [_STAR, _HOST_END, *body]


class Automaton:
    """The rules' states for any number of URLs at once."""

    def __init__(self, rules: list[Rule | Glob]):
        places: list[int] = []  # the sign each bit has taken; the first of a rule has taken none
        loops: list[bool] = []
        self.first, self.last = [], []
        for r in rules:
            self.first.append(len(places))
            places.append(_END)
            loops.append(False)
            for s in r.signs():
                if s == _STAR:
                    loops[-1] = True
                else:
                    places.append(s)
                    loops.append(False)
            self.last.append(len(places) - 1)
        self.words = max(1, -(-len(places) // 64))
        sign, loop = np.array(places or [_END]), np.array(loops or [False])
        start = np.zeros(self.words * 64, bool)
        start[self.first] = True
        takes = np.zeros((258, self.words * 64), bool)
        stays = np.zeros_like(takes)
        for c in range(257):
            takes[c, :len(sign)] = sign == c
            if c < 256:
                takes[c, :len(sign)] |= sign == _ANY
                stays[c, :len(loop)] = loop  # a star does not run over the end of the host
        stays[_END] = True
        self.start, self.takes, self.stays = _packed(start[None])[0], _packed(takes), _packed(stays)

    def fits(self, codes: np.ndarray) -> np.ndarray:
        """``codes``: URLs by characters, filled up with the end sign -> URLs by
        rules, whether each fits."""
        state = np.repeat(self.start[None], len(codes), axis=0)
        for column in codes.T:
            moved = state << np.uint64(1)
            moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
            state = moved & self.takes[column] | state & self.stays[column]
        last = np.array(self.last, np.int64)
        return (state[:, last >> 6] >> (last & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def canonical(hosts: list[bytes], paths: list[bytes]) -> np.ndarray:
    """One row of codes for each URL: a dot, the host, its end, the path."""
    urls = [b"." + h + b"/" + p for h, p in zip(hosts, paths)]
    n = np.array([len(u) for u in urls], np.int64)
    out = np.full((len(urls), int(n.max())), _END, np.int16)
    out[np.arange(out.shape[1]) < n[:, None]] = np.frombuffer(b"".join(urls), np.uint8)
    out[np.arange(len(urls)), [len(h) + 1 for h in hosts]] = _HOST_END
    return out


def parts(url: str):
    """Host and path columns of a URL column. Host: from the first ``://`` up to
    ``/``, ``?`` or ``#``, A-Z lower-cased; path: from there up to ``?`` or
    ``#``; both empty without ``://`` or for a null URL."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host = F.regexp_extract(text, "(?s)^.*?://([^/?#]*)", 1)
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(host, upper, upper.lower()), F.regexp_extract(text, "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_filter(pages: DataFrame, rules: list[Rule], globs: list[Glob] = (), *, default: str = "allow", id_col: str = "page_id",
               url_col: str = "url", batch: int = 4096) -> DataFrame:
    """Per page: ``id``, ``host``, ``path``, ``rule`` (the longest that fits, else
    null), ``pattern`` (the first glob that fits where no rule does, else null) and
    ``verdict``: the rule's, else the glob's, else ``default``.

    Of rules of one length that fit, one that blocks wins, then the smaller
    name. Null and malformed URLs have an empty host and path; no rule fits
    those. URLs of any length are read whole. One row per input row.
    """
    ranked = sorted(rules, key=lambda r: (len(r.name.encode()), r.verdict == "block", [-ord(c) for c in r.name]))
    signs = [*ranked, *globs]
    host, path = parts(url_col)

    def run(batches):
        machine = Automaton(signs)
        names = np.array([r.name for r in signs] + [None], dtype=object)
        verdicts = np.array([r.verdict for r in signs] + [default], dtype=object)
        for b in batches:
            for start, end in _runs(b, batch):
                part = b.slice(start, end - start)
                hosts, paths = part.column(1).to_pylist(), part.column(2).to_pylist()
                fit = machine.fits(canonical([h.encode() for h in hosts], [p.encode() for p in paths]))
                rule, glob = fit[:, :len(ranked)], fit[:, len(ranked):]
                best = np.where(rule.any(1), len(ranked) - 1 - rule[:, ::-1].argmax(1), -1) if ranked else np.full(len(fit), -1)
                first = np.where((best < 0) & glob.any(1), len(ranked) + glob.argmax(1), -1) if globs else np.full(len(fit), -1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(names[best], pa.string()), pa.array(names[first], pa.string()),
                     pa.array(verdicts[np.maximum(best, first)], pa.string())],
                    names=["id", "host", "path", "rule", "pattern", "verdict"])

    return pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).mapInArrow(
        run, f"id {id_type(pages, id_col)}, host string, path string, rule string, pattern string, verdict string")


def _runs(batch: pa.RecordBatch, most: int, cells: int = 2 << 20):
    """Runs of rows of at most ``most`` URLs whose table of codes stays small; a
    very long URL stands alone."""
    start, widest = 0, 0
    sizes = [len(h) + len(p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
    for i, n in enumerate(sizes):
        if i > start and (i - start >= most or max(widest, n) * (i - start + 1) > cells):
            yield start, i
            start, widest = i, 0
        widest = max(widest, n)
    if batch.num_rows > start:
        yield start, batch.num_rows
