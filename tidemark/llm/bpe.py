"""BPE encoding and decoding with a backtracking encoder.

An Aho-Corasick automaton lists, for every position of a word, the vocabulary
tokens that begin there.  The encoder takes the longest one that is compatible
with the token before it and steps back when none is; two tokens are compatible
when no merge of lower rank would have joined symbols across their border, which
is looked up in a table of token pairs (filled on demand).  Every position is
given up at most once, so a word takes linear time and the result is that of
applying the merges in order of rank.  Decoding gathers bytes through a table of
offsets into the concatenated vocabulary.

The vocabulary file is a parameter and is read on the driver; tasks get it by
broadcast (its size is that of the vocabulary, whatever the input).

Cases: null text is encoded as empty (no ids, empty decoded text); special
tokens' strings in a text become their ids; repeated rows and extra columns pass
through; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrow_text import map_texts

#: Chunks, and words, whose ids a task remembers; it starts anew beyond that.
REMEMBERED = 400_000
#: Stands for the end-of-word mark inside this module.
END = "\U0010ffff"
_ODD_SPACES = re.compile("[\x1c-\x1f]")
_SPACES = regex.compile(r"\p{White_Space}+")


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    spare = (chr(256 + i) for i in range(256))
    return {b: out.get(b) or next(spare) for b in range(256)}


#: The library's classes are those of Unicode 16; letters and digits that later versions added are neither to it.
LATE_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 "
    "16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF "
    "1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LATE_DIGITS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
#: Lower case as of Unicode 17, where Python's tables are older: first, last, distance.
LATE_LOWER = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27))
#: What the library's older normal forms leave where it stands: marks that they don't reorder, and the second half of one pair.
UNMOVED = (
    "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 "
    "119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)
_LOWER = {c: chr(c + d) for a, b, d in LATE_LOWER for c in range(a, b + 1)}
_LATE_UPPER = re.compile("[" + "".join(map(chr, _LOWER)) + "]")


def class_body(ranges: str) -> str:
    """The inside of a character class for ranges of hexadecimal code points."""
    return "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in ranges.split())


_UNMOVED = re.compile(f"([{class_body(UNMOVED)}])")


def composed(text: str) -> str:
    """Normal form C as the library has it."""
    if text.isascii() or not _UNMOVED.search(text):
        return unicodedata.normalize("NFC", text)
    return "".join(unicodedata.normalize("NFC", part) for part in _UNMOVED.split(text))


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file with word ends."""

    def __init__(self, spec: dict):
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        self.ids: dict[str, int] = {self._own(t, suffix): i for t, i in model["vocab"].items()}
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text: dict[int, str] = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.specials.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pairs: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            x, y = self._own(a, suffix), self._own(b, suffix)
            if x + y in self.ids:
                key, whole = (self.ids[x], self.ids[y]), self.ids[x + y]
                self.pairs.setdefault(key, r)
                if whole not in self.split:
                    self.split[whole], self.rank[whole] = key, r
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        letters, digits = class_body(LATE_LETTERS), class_body(LATE_DIGITS)
        own = {"[\\p{L}]+": f"[\\p{{L}}--[{letters}]]+", "[\\p{N}]": f"[\\p{{N}}--[{digits}]]", "[^\\s\\p{L}\\p{N}]+": f"(?:[^\\s\\p{{L}}\\p{{N}}]|[{letters}{digits}])+"}
        self.pattern = "|".join(own.get(way, way) for way in pattern.split("|"))

    @staticmethod
    def _own(token: str, suffix: str) -> str:
        return token[: -len(suffix)] + END if suffix and token.endswith(suffix) and token != suffix else token

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))


class Remembered(dict):
    """Ids of strings as bytes of 32-bit numbers; filled on demand and emptied at REMEMBERED entries."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, text: str) -> bytes:
        ids = self.make(text)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(text) < 100:
            self[text] = ids
        return ids


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.auto = ahocorasick.Automaton()
        for token, i in vocabulary.ids.items():
            self.auto.add_word(token, (len(token), i))
        self.auto.make_automaton()
        self.symbols = byte_symbols()
        self.words = regex.compile(vocabulary.pattern, regex.V1)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.specials, key=len, reverse=True))) + ")") if vocabulary.specials else None
        self.compatible: dict[tuple[int, int], bool] = {}
        # Words apart from the runs they occur in: most runs that are new differ in punctuation only.
        word = Remembered(lambda w: array("i", self.word(w)).tobytes()).__getitem__
        self.known = Remembered(lambda chunk: word(chunk) if chunk.isalpha() and chunk.isascii() else b"".join(map(word, self.words.findall(chunk))))

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a inside a word."""
        got = self.compatible.get((a, b))
        if got is None:
            if len(self.compatible) > 4 * REMEMBERED:
                self.compatible.clear()
            got = self.compatible[a, b] = self._fits(a, b)
        return got

    def _fits(self, a: int, b: int) -> bool:
        """Undoes the merges of both tokens from the last to the first and looks for one across the border that came earlier."""
        rank, split, pairs = self.v.rank, self.v.split, self.v.pairs
        limit = len(pairs) + 1  # merges of this rank and later come too late to matter
        while True:
            across = pairs.get((a, b))
            if across is not None and across < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # the right part of a stood at the border until merge ra; equal ranks join on the left first
                a, limit = split[a][1], ra
            else:
                b, limit = split[b][0], rb + 1

    def word(self, text: str) -> list[int]:
        """Ids of one word of the pattern."""
        symbols = "".join(map(self.symbols.__getitem__, text.encode())) + END
        begins: list[list[tuple[int, int]]] = [[] for _ in symbols]
        for last, (n, i) in self.auto.iter(symbols):
            begins[last - n + 1].append((last + 1, i))  # shortest first
        size, at, dead = len(symbols), 0, bytearray(len(symbols) + 1)
        taken: list[tuple[int, int, int]] = []  # position, choice at it, id
        choice = len(begins[0]) - 1
        while at < size:
            here, before = begins[at], taken[-1][2] if taken else None
            while choice >= 0:
                end, i = here[choice]
                if not dead[end] and (before is None or self.fits(before, i)):
                    break
                choice -= 1
            if choice >= 0:
                taken.append((at, choice, i))
                at = end
                choice = len(begins[at]) - 1 if at < size else 0
            elif taken:
                dead[at] = 1
                at, choice, _ = taken.pop()
                choice -= 1
            else:
                raise ValueError(f"no tokens for {text!r}")
        return [i for _, _, i in taken]

    def _plain(self, text: str) -> list[str]:
        text = composed(text)
        if not text.isascii() and _LATE_UPPER.search(text):
            text = _LATE_UPPER.sub(lambda m: _LOWER[ord(m[0])], text)
        if _ODD_SPACES.search(text):
            chunks = _SPACES.sub(" ", text).split(" ")
            return [x for c in chunks if c for x in [c.replace("Σ", "σ").lower()]]
        return text.replace("Σ", "σ").lower().split()

    def encode(self, text: str) -> bytes:
        """Ids of a text, as bytes of 32-bit numbers."""
        known = self.known.__getitem__
        if self.special is None or "<|" not in text:
            return b"".join(map(known, self._plain(text)))
        out = []
        for k, part in enumerate(self.special.split(text)):
            out += [array("i", [self.v.specials[part]]).tobytes()] if k % 2 else map(known, self._plain(part))
        return b"".join(out)


class Decoder:
    """Offsets into the concatenated token texts, a space after each."""

    def __init__(self, vocabulary: Vocabulary):
        top = max(vocabulary.text) + 1
        tokens = [(vocabulary.text.get(i, "") + " ").encode() for i in range(top)]
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)

    def decode(self, ids: Sequence[int]) -> bytes:
        """UTF-8 bytes of the tokens, joined by one space."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        begin, size = self.at[ids], self.at[ids + 1] - self.at[ids]
        into = np.cumsum(size) - size
        return self.blob[np.repeat(begin - into, size) + np.arange(into[-1] + size[-1])][:-1].tobytes()


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with column ids (array of int) and, if asked for, the decoded text; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        encoder, decoder = Encoder(shared.value), Decoder(shared.value) if decoded else None

        def routine(texts):
            ids = [encoder.encode(t.decode("utf-8", "replace")) if t else b"" for t in texts]
            at = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
            out = {"ids": pa.ListArray.from_arrays(at, np.frombuffer(b"".join(ids), np.int32))}
            return out | ({"decoded": [decoder.decode(np.frombuffer(i, np.int32)) for i in ids]} if decoded else {})

        return routine

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + ([T.StructField("decoded", T.StringType())] if decoded else [])
    return map_texts(docs, make, fields, text)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(docs, Vocabulary.read(path or default_path()), decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
