"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts every text into chunks, so equal passages
are cut alike in whatever document they stand. A task encodes each distinct
chunk once and remembers it (within a byte limit). Chunks are cut anywhere, also
inside words, so the tokens on both sides of a join can be wrong; they are
repaired: the text around the join, from the last white space of the left chunk
to the first of the right one, is encoded again. There both encodings agree,
since the tokenizers handled here never look across white space (checked when
the tokenizer is loaded). A chunk without white space agrees nowhere, and the
repaired stretch grows over as many chunks as it takes.

Nothing is shuffled: sending chunks and codes through an exchange would cost
more than the whole input, so reuse is per task. Exact agreement with the
tokenizer library is the test.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfrank.llm.common import id_type, out_batch, schema_of, slices, texts_of, utf8_input

#: Bytes in the rolling hash's window, the mean distance of its cuts, and the
#: smallest chunk.
ROLL = 16
MEAN_CHUNK = 1024
LEAST_CHUNK = 256
#: What a task remembers, in bytes of text; it forgets the older half beyond.
MEMO_BYTES = 6 << 20
MEMO_WORD_BYTES = 14 << 20

#: Signs that never share a token with a letter or digit before them.
_PUNCTUATION = b".,;:!?%#$&*"
#: The printable character that stands for each byte in the vocabulary: itself
#: where it is printable, else the next one from 256 on (fixed rule).
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = {b: b for b in _PRINTED} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_SPACE = b" \t\n\r\x0b\x0c"
_TABLE = np.cumprod(np.full(256, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64) ^ np.uint64(0x5851F42D4C957F2D)


def cuts(utf8: bytes, mean: int = MEAN_CHUNK, least: int = LEAST_CHUNK) -> list[int]:
    """Ends of the chunks. A cut stands after a byte where the hash of the last
    ROLL bytes is 0 in its top bits, before the first byte of a character and at
    least ``least`` bytes after the last cut."""
    n = len(utf8)
    if n <= least:
        return [n] if n else []
    data = np.frombuffer(utf8, np.uint8)
    h, width, power = _TABLE[data], 1, 0xD6E8FEB86659FD93
    while width < ROLL:
        h = h[width:] + h[:-width] * np.uint64(power)
        power, width = power * power % (1 << 64), 2 * width
    shift = np.uint64(64 - max(1, mean.bit_length() - 1))
    ends = np.flatnonzero(h >> shift == 0) + ROLL
    ends = ends[(ends < n) & ((data[np.minimum(ends, n - 1)] & 0xC0) != 0x80)]
    out, last = [], 0
    for e in ends.tolist():
        if e - last >= least:
            out.append(e)
            last = e
    return [*out, n]


class Memo(dict):
    """Remembers values by bytes. Beyond ``limit`` bytes of keys it drops all but
    what was asked for since the last time, or all."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.size, self.old = limit, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value):
        self[key] = value
        self.size += len(key) + 96
        if self.size > self.limit:
            self.old = dict(self)
            self.clear()
            self.size = 0


class Codec:
    """Encodes whole texts; ``encode`` gives ids as little-endian unsigned 32-bit
    integers and the decoded text, both as bytes."""

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        _check(spec)
        self.library = Tokenizer.from_str(json.dumps(spec))
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.found: dict[bytes, tuple[bytes, bytes]] = {}
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.strings = [(self.library.id_to_token(i) or "").encode() for i in range(size)]
        special = [t["content"] for t in spec["added_tokens"]]
        # a special token between two texts keeps them apart in one call
        self.mark = special[0] if special else None
        self.mark_id = self.library.token_to_id(self.mark) if special else None
        self.words = Memo(MEMO_WORD_BYTES)
        self.chunks = Memo(memo_bytes)

    # ------------------------------------------------------------- words

    def _learn(self, words: set[bytes]) -> None:
        """Encodes words (runs without ASCII white space)."""
        split, whole = [], set()
        for w in words:
            # punctuation behind a letter or digit is encoded on its own
            core = w.rstrip(_PUNCTUATION)
            if len(core) < len(w) and core[-1:].isalnum():
                split.append((w, core, w[len(core):]))
                whole.add(core)
                whole.add(w[len(core):])
            else:
                whole.add(w)
        slow = []
        for w in whole:
            known = self.words[w] if split else None
            if known is not None:
                self.found[w] = known
            elif (ids := self._one_word(w)) is not None:
                self._keep(w, ids)
            else:
                slow.append(w)
        mark = self.mark.encode() if self.mark else None
        plain = [w for w in slow if mark and mark not in w]
        for w in slow:
            if not mark or mark in w:
                self._keep(w, self.library.encode(w.decode(), add_special_tokens=False).ids)
        for start in range(0, len(plain), 5000):
            some = plain[start:start + 5000]
            ids = self.library.encode(mark.join(some).decode(), add_special_tokens=False).ids
            ends = np.flatnonzero(np.array(ids) == self.mark_id).tolist()
            for w, a, b in zip(some, [-1, *ends], [*ends, len(ids)]):
                self._keep(w, ids[a + 1:b])
        for w, core, tail in split:
            (a, x), (b, y) = self.found[core], self.found[tail]
            self._put(w, (a + b, x + b" " + y))

    def _one_word(self, word: bytes) -> list[int] | None:
        """Ids by the library's merges alone, where its normalizer and
        pre-tokenizer leave nothing else to do: Latin letters only."""
        text = word.decode()
        if not text.isalpha():
            return None
        low = text.lower()
        if not low.isascii():
            if max(text) >= "\u0250" or not low.isalpha():
                return None
            low = low.encode().decode("latin-1").translate(_BYTE_LEVEL)
        return [t.id for t in self.model.tokenize(low)]

    def _keep(self, word: bytes, ids: list[int]) -> None:
        self._put(word, (struct.pack(f"<{len(ids)}I", *ids), b" ".join([self.strings[i] for i in ids])))

    def _put(self, word: bytes, code: tuple[bytes, bytes]) -> None:
        self.found[word] = code
        if len(word) <= 64:
            self.words.put(word, code)

    def codes(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids and decoded text of each word."""
        out = list(map(self.words.__getitem__, words))
        if None in out:
            self.found = {}
            self._learn({w for w, x in zip(words, out) if x is None})
            out = [x if x is not None else self.found[w] for w, x in zip(words, out)]
            self.found = {}
        return out

    # ------------------------------------------------------------ chunks

    def encode_all(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """The exact encoding of every text."""
        cut = []
        new: dict[bytes, tuple] = {}
        for t in texts:
            ends = cuts(t)
            own = [t[a:b] for a, b in zip([0, *ends], ends)]
            cut.append(own)
            for c in own:
                if c not in new:
                    new[c] = self.chunks[c]
        fresh = [c for c, x in new.items() if x is None]
        split = [_edges(c) for c in fresh]
        flat = self.codes([w for s in split if s for w in s[1]])
        at = 0
        for c, s in zip(fresh, split):
            if s is None:
                new[c] = (None, b"", b"", None)
                continue
            head, body, tail = s
            mine = flat[at:at + len(body)]
            at += len(body)
            new[c] = (head, b"".join([x[0] for x in mine]), b" ".join([x[1] for x in mine if x[1]]), tail)
            self.chunks.put(c, new[c])
        seams, plans = [], []
        for own in cut:
            plan, open_text = [], b""
            for c in own:
                head, ids, text, tail = new[c]
                if head is None:
                    open_text += c
                    continue
                if open_text or head:
                    plan.append(None)
                    seams.append(open_text + head)
                plan.append((ids, text))
                open_text = tail
            if open_text:
                plan.append(None)
                seams.append(open_text)
            plans.append(plan)
        repaired = iter(self.codes(seams))
        out = []
        for plan in plans:
            parts = [p if p is not None else next(repaired) for p in plan]
            out.append((b"".join([p[0] for p in parts]), b" ".join([p[1] for p in parts if p[1]])))
        return out


def _edges(chunk: bytes) -> tuple[bytes, list[bytes], bytes] | None:
    """What stands before the first white space, the words between, and what
    stands after the last; None without white space."""
    words = chunk.split()
    if len(words) < 2 and not (words and len(words[0]) < len(chunk)) and words:
        return None
    if not words:
        return b"", [], b""
    head = b"" if chunk[:1] in _ASCII else words[0]
    tail = b"" if chunk[-1:] in _ASCII else words[-1]
    if len(words) == 1:
        # white space on one side at least: the word belongs to the other edge
        return (b"", [], tail) if tail else (head, [], b"") if head else (b"", words, b"")
    return head, words[bool(head):len(words) - bool(tail)], tail


_ASCII = {_SPACE[i:i + 1] for i in range(len(_SPACE))}


def _check(spec: dict) -> None:
    """Refuses tokenizers that look across white space."""
    kinds = lambda part, key: [(x["type"], x.get("pattern")) for x in (spec.get(part) or {}).get(key, [])]
    normal = kinds("normalizer", "normalizers") == [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    local = [x["type"] for x in pre] == ["Split", "ByteLevel"] and pre[0]["behavior"] == "Removed" and pre[0]["invert"] \
        and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in pre[0]["pattern"].get("Regex", "") and not pre[1]["add_prefix_space"] \
        and not pre[1]["use_regex"]
    if not (normal and local) or spec["model"]["type"] != "BPE" or spec.get("decoder") is not None or spec["model"].get("dropout"):
        raise ValueError("only BPE tokenizers that drop white space, without decoder or dropout, can be encoded in chunks")
    if any(t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"]):
        raise ValueError("added tokens that take in white space cannot be encoded in chunks")


@lru_cache(maxsize=2)
def _codec(path: str) -> Codec:
    """One codec for each tokenizer file in a Python worker."""
    return Codec(path)


def encode(docs: DataFrame, tokenizer: str | Callable[[], str], *, id_col: str = "doc_id", text_col: str = "text",
           carry: bool = False) -> DataFrame:
    """Per document: ``id``, ``n_tokens``, ``token_ids`` (little-endian unsigned
    32-bit integers) and ``decoded`` (the library's decode of the ids); ``carry``
    adds ``text`` and ``doc``, the other columns.

    ``tokenizer`` is the path of a tokenizer file that every executor can open,
    or a function that finds it there. Null and empty texts have no tokens and
    decode to the empty text. Texts are encoded whole, one row per input row.
    """
    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        codec = _codec(tokenizer() if callable(tokenizer) else tokenizer)
        for batch in batches:
            for part in slices(batch, 1 << 20):
                found = codec.encode_all(texts_of(part))
                yield out_batch(part, carry,
                                n_tokens=pa.array([len(i) // 4 for i, _ in found], pa.int64()),
                                token_ids=pa.array([i for i, _ in found], pa.binary()),
                                decoded=pa.array([d for _, d in found], pa.binary()).cast(pa.string()))

    source = utf8_input(docs, id_col, text_col, carry)
    return source.mapInArrow(
        run, schema_of(f"id {id_type(docs, id_col)}, n_tokens bigint, token_ids binary, decoded string", source))


def decode(encoded: DataFrame, tokenizer: str | Callable[[], str], *, id_col: str = "id", ids_col: str = "token_ids") -> DataFrame:
    """Per row: ``id`` and ``decoded``, the tokens' strings joined by a space, as
    the library decodes where a tokenizer names no decoder. Null ids decode to
    the empty text; an id outside the vocabulary adds nothing."""
    def run(batches):
        strings = np.array(_codec(tokenizer() if callable(tokenizer) else tokenizer).strings, dtype=object)
        for batch in batches:
            texts = []
            for x in batch.column(1):
                ids = np.frombuffer(x.as_py() or b"", "<u4")
                texts.append(b" ".join(s for s in strings[ids[ids < len(strings)]] if s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())],
                                             names=["id", "decoded"])

    return encoded.selectExpr(f"`{id_col}` as id", f"`{ids_col}` as ids").mapInArrow(
        run, f"id {id_type(encoded, id_col)}, decoded string")
