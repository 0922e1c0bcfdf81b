"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word the last token of its encoding is unique, and a token that ends
the prefix is that last one if and only if the last token before it and it are a compatible
pair, one that merging by rank would leave apart. Going through a word from left to right,
an automaton with suffix links gives the vocabulary's matches at each place, one pair test
each decides, and the found tokens' lengths are the back-pointers from which the ids are
read. No merge loop runs over the text.

A pair is tested on the two tokens' inner seams only: the pieces that lie at the border
while the left token is built (its right spine) and those of the right token (its left
spine). Merging would cross the border where two such pieces have a merge that comes before
the left piece and not after the right piece are used up; equal ranks go from left to right.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.normalizers import NFC, Lowercase
from tokenizers.pre_tokenizers import Split

from tableops.llm.common import by_value, pick, portions, whole_text, worker_store

#: Ends a word's last symbol; not in the byte alphabet.
END = "\n"
#: Words kept with their ids by a Python worker; beyond it the memory starts anew.
KEPT_WORDS = 500_000
#: Characters that a Python worker takes up at once.
AT_ONCE = 1_000_000
NEVER = 1 << 60


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: visible Latin-1 characters for themselves,
    the others for 256, 257, .. in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(plain)))
    return [out[b] for b in range(256)]


@cache
def _character_differences() -> tuple[str, dict[str, str]]:
    """The characters that only Python's Unicode tables take for letters or digits, and those
    that the tokenizers library lowers otherwise, with what it makes of them. Code points go by in
    blocks, so that only the differences are held."""
    newer, lower = [], {}
    words = Split(Regex(r"[\p{L}\p{N}]"), "removed", invert=True)
    for first in range(0, 0x110000, 4096):
        block = [chr(c) for c in range(first, first + 4096) if c != 10 and not 0xD800 <= c < 0xE000]
        text = "".join(block)
        known = {c for c, _ in words.pre_tokenize_str(text)}
        newer += [c for c in regex.findall(r"[\p{L}\p{N}]", text) if c not in known]
        lowered = Lowercase().normalize_str("\n".join(block)).split("\n")
        lower |= {c: low for c, low in zip(block, lowered) if c.lower() != low}
    return "".join(newer), lower | {"Σ": "σ"}


def load_spec(path: str) -> dict:
    """What the codec needs of a tokenizer file: vocabulary, merges in order, special tokens
    and the word pattern; ``newer`` and ``lower`` hold characters that Python's Unicode tables
    class or lower otherwise than the tokenizer's (a capital sigma never becomes a final one).
    Files of another shape raise ValueError."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    m, pre = t["model"], t["pre_tokenizer"]["pretokenizers"]
    shape = ([n["type"] for n in t["normalizer"]["normalizers"]], [p["type"] for p in pre], m["type"],
             m["end_of_word_suffix"], m["dropout"], t["post_processor"], t["decoder"])
    if shape != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "BPE", "</w>", None, None, None):
        raise ValueError(f"not a word-end BPE file: {shape}")
    newer, lower = _character_differences()
    return {"newer": newer, "lower": lower, "vocab": m["vocab"], "merges": [tuple(x) for x in m["merges"]], "suffix": m["end_of_word_suffix"],
            "special": {a["content"]: a["id"] for a in t["added_tokens"]}, "words": pre[0]["pattern"]["Regex"]}


class Codec:
    def __init__(self, spec: dict):
        self.suffix, self.special = spec["suffix"], spec["special"]
        pattern = spec["words"].replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(pattern)
        self.newer, self.lower = frozenset(spec["newer"]), spec["lower"]
        for kind in (r"\p{L}", r"\p{N}") if spec["newer"] else ():
            pattern = pattern.replace(kind, f"[{kind}--[{spec['newer']}]]")
        self.odd_words = regex.compile("(?V1)" + pattern)
        self.spaces = regex.compile(r"\p{White_Space}+")
        self.marks = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or "(?!)")
        self.nfc, self.marked = NFC(), regex.compile(r"[^\x00-\u02ff]")  # below, nothing combines
        self.alphabet = byte_alphabet()
        self.names = _names(spec)
        self.ids = {self._own(t): i for t, i in spec["vocab"].items()}
        self.length = {i: len(t) - t.endswith(END) for t, i in self.ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(spec["merges"]):
            a, b = self._own(a), self._own(b)
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank.setdefault((left, right), rank)
            self.split.setdefault(whole, (left, right, rank))
        self.pairs: dict[int, bool] = {}
        self.matches = ahocorasick.Automaton()
        sound = set()
        for t, i in sorted(self.ids.items(), key=lambda x: self.split.get(x[1], (0, 0, -1))[2]):
            left, right, _ = self.split.get(i, (None, None, -1))
            if left is None or (left in sound and right in sound and self._apart(left, right, inner=True)):
                sound.add(i)
                self.matches.add_word(t, i)
        self.matches.make_automaton()
        self.memory: dict[str, list[int]] = {}

    def _own(self, token: str) -> str:
        return token[:-len(self.suffix)] + END if token.endswith(self.suffix) else token

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(piece, rank of the merge that uses it up) from the token down to its last symbol."""
        out, used = [(token, NEVER)], NEVER
        while token in self.split:
            used, token = self.split[token][2], self.split[token][1 - side]
            out.append((token, used))
        return out

    def _apart(self, a: int, b: int, inner: bool = False) -> bool:
        """Whether merging leaves ``a`` and ``b`` apart; ``inner``: until they are whole."""
        for x, x_used in self._spine(a, 0):
            for y, y_used in self._spine(b, 1):
                r = self.rank.get((x, y))
                if r is not None and r < x_used and r <= y_used and not (inner and (x, y) == (a, b)):
                    return False
        return True

    def _word(self, word: str) -> list[int]:
        units = "".join(map(self.alphabet.__getitem__, word.encode())) + END
        length, pairs = self.length, self.pairs
        end_of_word = len(units) - 1  # symbols; END belongs to the last one
        last: list[int | None] = [None] * len(units)
        for end, token in self.matches.iter(units):  # the longest first at each end
            e = end + 1
            if e == end_of_word:
                continue  # the last symbol without its word end
            if e > end_of_word:
                e = end_of_word
            if last[e] is not None:
                continue
            s = e - length[token]
            if s:
                before = last[s]
                if before is None:
                    continue
                ok = pairs.get(before << 32 | token)
                if ok is None:
                    ok = pairs[before << 32 | token] = self._apart(before, token)
                if not ok:
                    continue
            last[e] = token
        out, e = [], end_of_word
        while e:
            out.append(last[e])
            e -= length[last[e]]
        out.reverse()
        return out

    def _chunk(self, chunk: str) -> list[int]:
        """Ids of text without white space; the word pattern never reaches over white space."""
        out: list[int] = []
        for word in (self.words if self.newer.isdisjoint(chunk) else self.odd_words).findall(chunk):
            ids = self.memory.get(word)
            if ids is None:
                if len(self.memory) >= KEPT_WORDS:
                    self.memory.clear()
                if len(self.pairs) >= KEPT_WORDS:
                    self.pairs.clear()
                ids = self._word(word)
                if len(word) <= 64:
                    self.memory[word] = ids
            out += ids
        return out

    def _plain(self, text: str, out: list[int]) -> None:
        if not text.isascii() and self.marked.search(text):
            text = self.nfc.normalize_str(text)  # with the tokenizer's own Unicode tables
        for c, low in self.lower.items():
            if c in text:
                text = text.replace(c, low)
        text = text.lower()
        # str.split() takes four control characters for space, which the normaliser does not
        chunks = text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else self.spaces.split(text)
        get = self.memory.get
        for chunk in chunks:
            ids = get(chunk)
            out += self._chunk(chunk) if ids is None else ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for m in self.marks.finditer(text):
            self._plain(text[at:m.start()], out)
            out.append(self.special[m[0]])
            at = m.end()
        self._plain(text[at:] if at else text, out)
        return out

    def decode(self, ids) -> str:
        return " ".join([self.names[i] for i in ids])


def _shared(df: DataFrame, path: str) -> tuple[Broadcast, int]:
    b = df.sparkSession.sparkContext.broadcast(load_spec(path))  # bounded by the vocabulary
    return b, b._jbroadcast.id()


def _codec(spec: Broadcast, number: int) -> Codec:
    """One codec, with the words that it knows, for all tasks of a Python worker."""
    kept = worker_store()
    if kept.get("codec", (None,))[0] != number:
        kept["codec"] = number, Codec(spec.value)
    return kept["codec"][1]


def _list(rows: list[list[int]]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=offsets[-1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _names(spec: dict) -> dict[int, str]:
    return {i: t for t, i in (spec["vocab"] | spec["special"]).items()}


def _key_type(base: DataFrame) -> str:
    return base.schema["_key"].dataType.simpleString()


def recode_texts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: ``key``, ``ids`` of the whole text with the tokenizer file
    at ``path`` (read on the driver) and ``decoded``, the tokens of ``ids`` joined by spaces,
    as a tokenizer without a decoder gives them.

    NULL and empty texts have no ids and decode to the empty text. The strings of special
    tokens in a text become those tokens; none are added. Rows are independent of each
    other, so repeated rows, NULL keys and empty tables need no rule."""
    spec, number = _shared(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec, number)
        for batch in batches:
            for start, texts in portions(batch, 1, AT_ONCE):
                rows = [codec.encode(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), _list(rows), pa.array(map(codec.decode, rows), pa.string())],
                    names=[key, "ids", "decoded"])

    base = pick(df, _key=key, _text=text).withColumn("_text", whole_text("_text"))
    return base.mapInArrow(run, f"`{key}` {_key_type(base)}, ids array<int>, decoded string")


def encode_texts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids``, as ``recode_texts``."""
    return recode_texts(df, path, key, text).select(key, "ids")


def decode_ids(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``decoded`` for a table of ids; NULL ids decode to the empty text."""
    spec, _ = _shared(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _names(spec.value)
        for batch in batches:
            texts = [" ".join([names[i] for i in r.as_py() or ()]) for r in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "decoded"])

    base = pick(df, _key=key, _ids=ids)
    return base.mapInArrow(run, f"`{key}` {_key_type(base)}, decoded string")


def ids_digest(ids):
    """Column: lowercase SHA-256 of ids as little-endian unsigned 32-bit integers."""
    @F.pandas_udf("string")
    def digest(rows):
        import hashlib
        return rows.map(lambda r: hashlib.sha256(np.asarray(r, dtype="<u4").tobytes()).hexdigest())
    return digest(ids)


by_value(__name__)
