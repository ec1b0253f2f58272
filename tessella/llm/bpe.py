"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is exactly one token that can end its BPE
encoding.  The tokens that are suffixes of the prefix come from an automaton
over the vocabulary; of these, the one is right whose left neighbour (already
known: the last token of the shorter prefix) is compatible with it, that is,
BPE would leave the border between both.  Following the stored tokens back from
the whole word gives exactly the ids that merging by rank gives, in time linear
in the word, however long it is.

The vocabulary is read once on the driver from a path that is a parameter, and
broadcast (its size is fixed: it doesn't depend on the data).  Which code points
are letters or numbers, and how marks are composed, depends on the Unicode
version.  Python's tables are used for what they know; the tokenizers library is
asked, once on the driver, about the rest and about marks that its own tables
may not know, and normalises the rare texts that have such a code point.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import shipped, table, tidy

#: The word pattern that a file must name, and its form for texts of Latin-1 letters (letters first, as most words begin with one).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_WORDS = re.compile(r"[a-zA-ZªµºÀ-ÖØ-öø-ÿ]+|'(?:[stmd]|re|ve|ll)|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-zA-ZªµºÀ-ÖØ-öø-ÿ0-9²³¹¼-¾]+")
#: White space, as a character class; the steps before BPE that a file must name; and the settings that its model must have.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
#: Code points from here on are in planes without letters and numbers.
UNLETTERED = 0x40000
#: The last code point of the basic plane.
BASIC = 0xFFFF
BEYOND_BASIC = re.compile("[\U00010000-\U0010ffff]")
#: A worker forgets its words beyond this many; memory stays bounded, results are the same.
CACHED_WORDS = 200_000
CACHED_PAIRS = 100_000
LONG_WORD = 100
NEVER = 1 << 40


@dataclass(frozen=True)
class Vocabulary:
    """A BPE vocabulary as plain lists: ``tokens[id]``, merges (left, right, id) by rank, the base ids, and special strings."""

    tokens: list[str]
    merges: list[tuple[int, int, int]]
    inner: list[int]  # the id of each byte inside a word
    final: list[int]  # the id of each byte that ends a word
    special: list[tuple[str, int]]
    letters: tuple[tuple[int, int], ...] = ()  # ranges of code points
    numbers: tuple[tuple[int, int], ...] = ()
    unsure: tuple[tuple[int, int], ...] = ()  # what Python may normalise otherwise than the library

    @property
    def key(self) -> str:
        return hashlib.sha256(json.dumps([self.tokens, self.merges, self.special, self.letters, self.numbers, self.unsure]).encode()).hexdigest()


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def _ranges(points: list[int]) -> tuple[tuple[int, int], ...]:
    """Rising code points as ranges."""
    cuts = [i for i in range(1, len(points)) if points[i] != points[i - 1] + 1]
    return tuple((points[a], points[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(points)], strict=True)) if points else ()


def _class(ranges: tuple[tuple[int, int], ...], last: int) -> str:
    """The ranges up to a code point as the inside of a character class."""
    return "".join(f"\\U{a:08x}-\\U{min(b, last):08x}" for a, b in ranges if a <= last)


@functools.cache
def word_classes() -> tuple[tuple[tuple[int, int], ...], ...]:
    """Letters, numbers, and what the library may normalise otherwise than Python, as ranges.

    For what Python's tables don't know the library splits ``xccx``: a letter
    gives one piece, a number four, anything else three.  The library's tables
    of marks and compositions are older than Python's; those that it doesn't
    know show when it orders or composes them.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    points: dict[str, list[int]] = {"L": [], "N": [], "?": []}
    for c in range(UNLETTERED):
        kind = unicodedata.category(chr(c))
        points.setdefault("?" if kind == "Cn" else kind[0], []).append(c)
    unknown = points["?"]
    pieces = pre_tokenizers.Split(Regex(PATTERN), "removed", invert=True).pre_tokenize_str("".join(f"x{chr(c)}{chr(c)}x " for c in unknown))
    counts = [0] * len(unknown)
    for _, (start, _) in pieces:
        counts[start // 5] += 1
    of = {1: "L", 4: "N"}
    for c, n in zip(unknown, counts, strict=True):
        if n in of:
            points[of[n]].append(c)
    nfc, otherwise = normalizers.NFC(), set(unknown)
    for c in range(UNLETTERED):
        parts = [int(x, 16) for x in unicodedata.decomposition(chr(c)).split() if x[0] != "<"] if unicodedata.decomposition(chr(c))[:1] != "<" else []
        probes = ["".join(map(chr, parts))] if parts else []
        if unicodedata.combining(chr(c)):
            probes += [f"a{chr(c)}\u0334", f"a\u0316{chr(c)}", f"e{chr(c)}\u0301"]
        if any(nfc.normalize_str(p) != unicodedata.normalize("NFC", p) for p in probes):
            otherwise.update([c, *parts])
    return _ranges(sorted(points["L"])), _ranges(sorted(points["N"])), _ranges(sorted(otherwise))


def load_vocabulary(path: str) -> Vocabulary:
    """Read a tokenizers JSON file; one whose steps before BPE, or whose model's settings, are not those built here is refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    plain = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    asked = {
        "normalizer": (spec.get("normalizer"), NORMALIZER),
        "pre_tokenizer": (spec.get("pre_tokenizer"), PRE_TOKENIZER),
        "decoder": (spec.get("decoder"), None),
        "model": ({k: model.get(k) for k in MODEL}, MODEL),
        "added_tokens": ([{k: x.get(k) for k in plain} for x in spec["added_tokens"]], [plain] * len(spec["added_tokens"])),
    }
    if other := [k for k, (has, needs) in asked.items() if has != needs]:
        raise ValueError(f"{path} has another {', '.join(other)} than this encoder builds")
    end = model["end_of_word_suffix"]
    ids = model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    special = [(x["content"], x["id"]) for x in spec["added_tokens"]]
    tokens = [""] * (max([*ids.values(), *(i for _, i in special)]) + 1)
    for t, i in [*ids.items(), *special]:
        tokens[i] = t
    letters = byte_letters()
    return Vocabulary(tokens, [(ids[a], ids[b], ids[a + b]) for a, b in pairs], [ids[x] for x in letters], [ids[x + end] for x in letters], special, *word_classes())


class PrefixEncoder:
    """Encodes single words; a word is a string of units, one for each byte, the last byte's raised by 256."""

    def __init__(self, vocabulary: Vocabulary):
        n = len(vocabulary.tokens)
        self.rank: dict[tuple[int, int], int] = {}
        self.formed, self.left, self.right = [-1] * n, [0] * n, [0] * n
        units: dict[int, str] = {}
        for b in range(256):
            units[vocabulary.inner[b]] = chr(b)
            units[vocabulary.final[b]] = chr(b + 256)
        for r, (a, b, made) in enumerate(vocabulary.merges):
            self.rank.setdefault((a, b), r)
            if a not in units or b not in units:
                raise ValueError("a token is merged before its parts; prefixes then don't determine their last token")
            if made not in units:
                units[made] = units[a] + units[b]
                self.formed[made], self.left[made], self.right[made] = r, a, b
        self.stable: dict[int, bool] = {}
        for i in sorted(units, key=lambda x: self.formed[x]):
            a, b = self.left[i], self.right[i]
            self.stable[i] = self.formed[i] < 0 or (self.stable[a] and self.stable[b] and self.apart(a, b, self.formed[i]))
        self.matches = ahocorasick.Automaton()
        for i, u in units.items():
            if self.stable[i]:
                self.matches.add_word(u, (i, len(u)))
        self.matches.make_automaton()
        self.known: dict[int, bool] = {}

    def apart(self, a: int, b: int, before: int = NEVER) -> bool:
        """True if BPE leaves the border between the tokens a and b, looking at merges of a rank below ``before``.

        Going back in time, the pieces beside the border are the tokens, then
        the parts that they were made of.  Two pieces merge if their rank is
        below that of the merge which takes one of them away; of equal ranks
        the merge further left goes first.
        """
        rank, formed = self.rank, self.formed
        while True:
            if rank.get((a, b), NEVER) < before:
                return False
            if formed[a] > formed[b]:
                before, a = formed[a], self.right[a]
            elif formed[b] >= 0:
                before, b = formed[b] + 1, self.left[b]
            else:
                return True

    def encode(self, units: str) -> list[int]:
        """The ids of a word, exactly as merging by rank gives them."""
        last, size = [-1] * (len(units) + 1), [0] * (len(units) + 1)
        known = self.known
        for at, (token, length) in self.matches.iter(units):
            at += 1
            if last[at] >= 0:
                continue
            if length != at:
                pair = last[at - length] << 32 | token
                fits = known.get(pair)
                if fits is None:
                    if len(known) >= CACHED_PAIRS:
                        known.clear()
                    fits = known[pair] = self.apart(last[at - length], token)
                if not fits:
                    continue
            last[at], size[at] = token, length
        at, ids = len(units), []
        while at:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]


class Words(dict):
    """The ids of each word as bytes, filled as words turn up.

    When half as many words as may be kept are there, they become the older half
    and the half before them goes, so words that turn up again and again stay.
    Long words are forgotten after the text that they stand in.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.encoder = PrefixEncoder(vocabulary)
        self.older: dict[str, bytes] = {}
        self.long: list[str] = []

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is not None:
            self[word] = out
            return out
        b = word.encode("utf-8", "surrogatepass")
        if len(b) > LONG_WORD:
            self.long.append(word)
        ids = self.encoder.encode(b[:-1].decode("latin-1") + chr(b[-1] + 256))
        out = self[word] = b"".join(i.to_bytes(4, "little") for i in ids)
        return out

    def trim(self) -> None:
        for word in self.long:
            self.pop(word, None)
        self.long.clear()
        if len(self) > CACHED_WORDS // 2:
            self.older = dict(self)
            self.clear()


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.words, self.special = Words(vocabulary), dict(vocabulary.special)
        self.split = re.compile("(" + "|".join(re.escape(s) for s, _ in vocabulary.special) + ")") if vocabulary.special else None
        # a class without the ranges beyond the basic plane is a table, which is much faster
        self.wide = {}
        for last in (BASIC, UNLETTERED):
            letters, numbers, unsure = (_class(r, last) for r in (vocabulary.letters, vocabulary.numbers, vocabulary.unsure))
            self.wide[last] = re.compile(f"[{letters}]+|'(?:[stmd]|re|ve|ll)|[{numbers}]|[^{SPACE}{letters}{numbers}]+"), re.compile(f"[{unsure}]")
        self.tokens = pa.array(vocabulary.tokens, pa.large_string())
        self._normalizer = None

    def pieces(self, text: str) -> list[str]:
        """The words of a text: NFC, each letter lower-cased by itself (so that a sigma doesn't look at its place in the word), and split."""
        if text.isascii():
            return LATIN_WORDS.findall(text.lower())
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            words, unsure = self.wide[UNLETTERED if BEYOND_BASIC.search(text) else BASIC]
            if unsure.search(text):
                if self._normalizer is None:
                    from tokenizers import normalizers

                    self._normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
                return self.wide[UNLETTERED][0].findall(self._normalizer.normalize_str(text))
            return words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        return LATIN_WORDS.findall(text.lower())

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        ids: list[bytes] = []
        parts = self.split.split(text) if self.split and text and any(s in text for s in self.special) else [text or ""]
        for part in parts:
            if part in self.special:
                ids.append(self.special[part].to_bytes(4, "little"))
                continue
            ids.append(b"".join(map(self.words.__getitem__, self.pieces(part))))
            self.words.trim()
        return b"".join(ids)

    def decode_many(self, texts: list[bytes]) -> pa.Array:
        """The texts of lists of ids: their tokens, joined by spaces."""
        counts = np.fromiter((len(x) // 4 for x in texts), np.int64, len(texts))
        tokens = self.tokens.take(pa.array(np.frombuffer(b"".join(texts), "<u4")))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)])), tokens), pa.scalar(" ", pa.large_string()))

    def decode(self, ids: bytes) -> str:
        return self.decode_many([ids])[0].as_py()


_CODECS: dict[str, Codec] = {}


def codec(key: str, vocabulary: Vocabulary) -> Codec:
    """The worker's codec; Python workers are reused, so it is built once in each."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocabulary)
    return _CODECS[key]


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False) -> DataFrame:
    """Encode every whole text; one row out for each row in, without a shuffle.

    Returns the id, ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit)
    and ``decoded``; with ``digests_only``, their SHA-256 in place of the last
    two, so that the long columns aren't sent back.

    Defined cases: a null text counts as empty and has no tokens; ids may be
    null or repeat; other columns, whatever their names, are ignored; an empty
    table gives an empty result.  Strings of special tokens in a text become
    their ids.
    """
    spark = shipped(docs.sparkSession)
    shared, key = spark.sparkContext.broadcast(vocabulary), vocabulary.key
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    fields = [T.StructField(id_col, source.schema["id"].dataType), T.StructField("n_tokens", T.LongType())]
    ends_ = (("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())) if digests_only else (("ids", T.BinaryType()), ("decoded", T.StringType()))
    fields += [T.StructField(n, t) for n, t in ends_]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(key, shared.value)
        for batch in batches:
            encoded, at, held = [], 0, 0
            for text in batch.column(1):
                encoded.append(own.encode(text.as_py()))
                held += len(encoded[-1])
                if held > 1 << 22:
                    yield pack(own, batch.column(0).slice(at, len(encoded)), encoded)
                    at, held, encoded = at + len(encoded), 0, []
            if encoded:
                yield pack(own, batch.column(0).slice(at, len(encoded)), encoded)

    def pack(own: Codec, ids: pa.Array, encoded: list[bytes]) -> pa.RecordBatch:
        decoded = own.decode_many(encoded)
        if digests_only:
            ends = [[hashlib.sha256(x).hexdigest() for x in encoded], [hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded]]
        else:
            ends = [pa.array(encoded, pa.binary()), decoded.cast(pa.string())]
        columns = [ids, pa.array([len(x) // 4 for x in encoded], pa.int64()), *map(pa.array, ends)]
        return pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return source.mapInArrow(tidy(run), T.StructType(fields))


def op8_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count and the digests of its ids and of their decoding."""
    import public_tokenizers

    vocabulary = load_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return encode_texts(table(spark, sf_dir, "documents"), vocabulary, digests_only=True)
