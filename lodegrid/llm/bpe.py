"""BPE encoding and decoding over distinct words, by a prefix-sharing trie.

A BPE encoding is the only token sequence in which every adjacent pair of tokens encodes to itself.
So the encoding of a prefix is known by its last token alone: the one token that ends there and is
compatible with the last token of the prefix before it. A batch's distinct words, sorted, are their
trie laid out depth first (what a word shares with the word before it is the path that is kept), and a
walk over it carries the last tokens of the current path, so the states of a shared prefix are found
once. The last letter of a word is another symbol (with the end-of-word mark), so each word adds one
closing step of its own.

Texts are cut at white space; what stands between is looked up in a table of chunks already encoded,
whose size is bounded (it is a cache: chunks that it has lost are encoded again).
"""

from __future__ import annotations

import functools
import gc
import json
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodegrid.llm.common import free_name, table, with_text

#: Chunks, and pairs of tokens, that a worker remembers.
CACHE, PAIRS = 200_000, 400_000
#: Texts of these characters only are cut by the patterns below; the others go through the library's
#: own normaliser and pre-tokeniser. Ranges in which both agree by the Unicode tables.
_SAFE = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ſ‐-‧‰-⁞]*")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_LETTER = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others take the code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """A tokenizer file of the word-end kind: byte-level BPE whose last symbol carries a suffix."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.source = source
        self.suffix = model["end_of_word_suffix"]
        to_byte = {c: b for b, c in byte_alphabet().items()}
        self.to_byte = str.maketrans({c: chr(b) for c, b in to_byte.items()})
        tokens: dict[int, str] = {i: t for t, i in model["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        # inner tokens and closing tokens, by their bytes
        self.inner: dict[bytes, int] = {}
        self.closing: dict[bytes, int] = {}
        for t, i in model["vocab"].items():
            closes = t.endswith(self.suffix) and len(t) > len(self.suffix)
            body = t.removesuffix(self.suffix) if closes else t
            if all(c in to_byte for c in body):
                (self.closing if closes else self.inner)[bytes(to_byte[c] for c in body)] = i
        self.text = {i: (b, False) for b, i in self.inner.items()} | {i: (b, True) for b, i in self.closing.items()}
        ids = model["vocab"]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.made = {out: (rank, pair) for pair, (rank, out) in self.merges.items()}
        self.names = [tokens.get(i) for i in range(max(tokens) + 1)]

    @functools.cached_property
    def library(self) -> Tokenizer:
        """The library's own tokenizer, for the texts that need it."""
        made = Tokenizer.from_str(self.source)
        made.no_truncation()
        made.no_padding()
        return made

    def merged(self, body: bytes, closes: bool) -> list[int]:
        """Plain BPE of one word by its merge ranks; the trie asks it about single tokens only."""
        out = [self.inner[body[i : i + 1]] for i in range(len(body))]
        if closes:
            out[-1] = self.closing[body[-1:]]
        while len(out) > 1:
            rank, at = min((self.merges.get(p, (1 << 60,))[0], i) for i, p in enumerate(zip(out, out[1:], strict=False)))
            if rank == 1 << 60:
                break
            out[at : at + 2] = [self.merges[out[at], out[at + 1]][1]]
        return out


class TrieEncoder:
    """Encodes distinct words by the depth-first walk that the module describes."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.compatible: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.ends: dict[int, list[tuple[int, int, int]]] = {}
        self.starts: dict[int, list[tuple[int, int, int]]] = {}
        self.inner_lengths = self._lengths(vocabulary.inner)
        self.closing_lengths = self._lengths(vocabulary.closing)

    @staticmethod
    def _lengths(tokens: dict[bytes, int]) -> dict[bytes, list[int]]:
        """For the last two bytes of a prefix, the lengths of the tokens that end so, longest first."""
        out: dict[bytes, set[int]] = {}
        for b in tokens:
            out.setdefault(b[-2:], set()).add(len(b))
        return {k: sorted(v, reverse=True) for k, v in out.items()}

    def _edge(self, token: int, side: int, chains: dict[int, list[tuple[int, int, int]]]) -> list[tuple[int, int, int]]:
        """The pieces of ``token`` that in turn stand at one of its ends while it is merged together, the
        shortest first: (piece, rank of the merge that makes it, rank of the merge that takes it up)."""
        if token not in chains:
            born, inner = self.v.made.get(token, (-1, None))
            below = self._edge(inner[side], side, chains) if inner else []
            chains[token] = [*below[:-1], *((p, b, born) for p, b, _ in below[-1:]), (token, born, 1 << 60)]
        return chains[token]

    def _fits(self, before: int, token: int) -> bool:
        """Whether the two tokens, side by side, stay as they are: no piece at the end of one ever merges
        with a piece at the start of the other. Equal merges go from left to right."""
        if not self._whole(token):
            return False
        if before < 0:
            return True
        a, b = self._edge(before, 1, self.ends), self._edge(token, 0, self.starts)
        i = j = 0
        while i < len(a) and j < len(b):
            (p, p_from, p_to), (q, q_from, q_to) = a[i], b[j]
            merge = self.v.merges.get((p, q))
            if merge is not None:
                at = max(merge[0], p_from, q_from)
                if at < p_to and at <= q_to:
                    return False
            if p_to <= q_to:
                i += 1
            else:
                j += 1
        return True

    def _whole(self, token: int) -> bool:
        if token not in self.alone:
            self.alone[token] = self.v.merged(*self.v.text[token]) == [token]
        return self.alone[token]

    def _last(self, word: bytes, end: int, path: list[int], tokens: dict[bytes, int], lengths: dict[bytes, list[int]]) -> int:
        """The last token of word[:end], given those of all shorter prefixes."""
        known = self.compatible
        tail = word[max(0, end - 2) : end]
        for n in lengths.get(tail, ()) if end > 1 else ():
            if n <= end and (token := tokens.get(word[end - n : end])) is not None:
                key = (path[end - n] + 1) << 32 | token
                fits = known.get(key)
                if fits is None:
                    fits = known[key] = self._fits(path[end - n], token)
                if fits:
                    return token
        return tokens[word[end - 1 : end]]

    def encode(self, words: Iterable[str]) -> dict[str, bytes]:
        """Each word's ids as little-endian 32-bit integers."""
        if len(self.compatible) > PAIRS:
            self.compatible.clear()
            self.ends.clear()
            self.starts.clear()
        out, path, before = {}, [-1], b""
        text = self.v.text
        for body, word in sorted((w.encode("utf-8"), w) for w in words):
            shared, most = 0, min(len(before), len(body) - 1)
            while shared < most and before[shared] == body[shared]:
                shared += 1
            # the last letter of the word before was not walked as an inner symbol
            del path[min(shared, len(path) - 1) + 1 :]
            for end in range(len(path), len(body)):
                path.append(self._last(body, end, path, self.v.inner, self.inner_lengths))
            ids, end = [self._last(body, len(body), path, self.v.closing, self.closing_lengths)], len(body)
            while (end := end - len(text[ids[-1]][0])) > 0:
                ids.append(path[end])
            out[word] = np.array(ids[::-1], "<u4").tobytes()
            before = body
        return out


class LibraryEncoder(dict):
    """Encodes distinct words with the tokenizers library's model; a table of words that it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary
        self.tokenize = vocabulary.library.model.tokenize
        self.letters = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})

    def __missing__(self, word: str) -> bytes:
        symbols = word if word.isascii() and word.isalnum() else word.encode("utf-8").decode("latin-1").translate(self.letters)
        ids = self[word] = array("I", [t.id for t in self.tokenize(symbols)]).tobytes()
        return ids

    def encode(self, words: Iterable[str]) -> dict[str, bytes]:
        if len(self) > CACHE:
            self.clear()
        return {w: self[w] for w in words}


class _Chunks(dict):
    """Chunks of plain texts and their ids, encoded when first met."""

    def __init__(self, words: LibraryEncoder):
        super().__init__()
        self.words = words

    def __missing__(self, chunk: str) -> bytes:
        words = self.words
        found = [chunk] if chunk.isascii() and chunk.isalpha() else _WORD.findall(chunk)
        ids = self[chunk] = words[found[0]] if len(found) == 1 else b"".join([words[w] for w in found])
        return ids


class TextEncoder:
    """Whole texts to ids by way of their distinct chunks."""

    def __init__(self, vocabulary: Vocabulary, words: TrieEncoder | LibraryEncoder):
        self.v, self.words = vocabulary, words
        self.direct = isinstance(words, LibraryEncoder)
        self.chunks: dict[str, bytes] = _Chunks(words) if self.direct else {}

    def _cut(self, text: str) -> list[str]:
        """The chunks of a plain text."""
        return text.lower().split()

    @staticmethod
    def plain(text: str) -> bool:
        return not _CONTROL.search(text) if text.isascii() else _SAFE.fullmatch(text) is not None

    def _rare(self, text: str) -> bytes:
        """Texts outside the safe ranges: the library normalises and cuts them. Its words are encoded as any."""
        v, out = self.v, []
        for piece in self._segments(text):
            if piece in v.added:
                out.append(np.array([v.added[piece]], "<u4").tobytes())
                continue
            raw = [w.translate(v.to_byte).encode("latin-1") for w, _ in v.library.pre_tokenizer.pre_tokenize_str(v.library.normalizer.normalize_str(piece))]
            if isinstance(self.words, LibraryEncoder):
                out.append(np.array(v.library.encode(piece, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                words = [w.decode("utf-8") for w in raw]
                known = self.words.encode(set(words))
                out.extend(known[w] for w in words)
        return b"".join(out)

    def _segments(self, text: str) -> list[str]:
        v, at, out = self.v, 0, []
        for m in v.specials.finditer(text) if v.specials else ():
            out += [text[at : m.start()], m[0]]
            at = m.end()
        return [s for s in [*out, text[at:]] if s]

    def _is_plain(self, text: str) -> bool:
        return (self.v.specials is None or "<|" not in text or not self.v.specials.search(text)) and self.plain(text)

    def encode_bytes(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers, words encoded one by one as they are met."""
        if len(self.chunks) > CACHE:
            self.chunks.clear()
        if len(self.words) > CACHE:
            self.words.clear()
        get = self.chunks.__getitem__
        return [b"" if not t else b"".join(map(get, self._cut(t))) if self._is_plain(t) else self._rare(t) for t in texts]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if self.direct:
            return [np.frombuffer(b, "<u4") for b in self.encode_bytes(texts)]
        cut: list[list[str] | bytes] = []
        wanted: set[str] = set()
        for text in texts:
            if not text:
                cut.append(b"")
            elif self._is_plain(text):
                cut.append(self._cut(text))
                wanted.update(cut[-1])
            else:
                cut.append(self._rare(text))
        if len(self.chunks) > CACHE:
            self.chunks = {}
        new = wanted - self.chunks.keys()
        single = {c for c in new if c.isascii() and c.isalpha()}
        parts = {c: _WORD.findall(c) for c in new - single}
        known = self.words.encode(single.union(*parts.values()))
        for c in single:
            self.chunks[c] = known[c]
        for c, p in parts.items():
            self.chunks[c] = known[p[0]] if len(p) == 1 else b"".join([known[w] for w in p])
        get = self.chunks.__getitem__
        return [np.frombuffer(c if isinstance(c, bytes) else b"".join(map(get, c)), "<u4") for c in cut]


class Shipped:
    """A tokenizer file, to be broadcast. A worker builds the encoder when it first needs it and keeps it between
    tasks of the same operator; a worker that goes on with another operator drops it with the broadcast."""

    def __init__(self, source: str, kind: type):
        self.source, self.kind, self.made = source, kind, None

    def __getstate__(self) -> tuple[str, type]:
        return self.source, self.kind

    def __setstate__(self, state: tuple[str, type]) -> None:
        self.__init__(*state)

    def encoder(self) -> TextEncoder:
        if self.made is None:
            gc.set_threshold(200_000, 20, 100)  # the tables hold no cycles, so collecting often only costs
            vocabulary = Vocabulary(self.source)
            self.made = TextEncoder(vocabulary, self.kind(vocabulary))
        return self.made


def ship(df: DataFrame, tokenizer: str, kind: type) -> Broadcast[Shipped]:
    """The tokenizer file (under 2 MB, a fixed size), read by the driver, for all tasks."""
    with open(tokenizer, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(Shipped(f.read(), kind))


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(df: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` and the ids of each whole text (array<int>, empty for null and empty texts).

    ``tokenizer`` is a path that the driver reads; executors get its content (under 2 MB, a fixed
    size). Repeated rows repeat; other columns pass through. ``ids_col`` replaces a column of that name.
    """
    if ids_col.lower() == text_col.lower():
        raise ValueError(f"output column {ids_col} is the text column")
    shipped = ship(df, tokenizer, TrieEncoder)
    name = free_name(df, "_ids")
    made = with_text(df, text_col, lambda texts: [lists(shipped.value.encoder().encode(texts))], f"{name} array<int>")
    return made.drop(ids_col).withColumnRenamed(name, ids_col)


def decoded(names: list[str | None], ids: Iterable[int | None]) -> str:
    """The tokens of ``ids`` joined by spaces; ids that the vocabulary lacks, negative ones and nulls give nothing."""
    return " ".join([t for i in ids if i is not None and 0 <= i < len(names) and (t := names[i]) is not None])


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` and the text of each array of ids, as the library's decode gives it for a file that names
    no decoder: the tokens joined by spaces, special ones included. Null arrays give null; ids that are
    null or outside the vocabulary give nothing, as in the library."""
    shipped = ship(df, tokenizer, TrieEncoder)
    name = free_name(df, "_decoded")

    def run(rows: list[list[int] | None]) -> list[pa.Array]:
        names = shipped.value.encoder().v.names
        return [pa.array([None if r is None else decoded(names, r) for r in rows], pa.string())]

    made = with_text(df, ids_col, run, f"{name} string")
    return made.drop(out_col).withColumnRenamed(name, out_col)


def round_trip(df: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``df``, the ids of each text as column ``ids`` and their decoded text as ``decoded``, in one pass.

    Columns of those names are replaced.
    """
    shipped = ship(df, tokenizer, TrieEncoder)
    names = free_name(df, "_ids"), free_name(df, "_decoded")

    def run(texts: list[str | None]) -> list[pa.Array]:
        encoder = shipped.value.encoder()
        ids, token = encoder.encode(texts), encoder.v.names.__getitem__
        return [lists(ids), pa.array([" ".join(map(token, i.tolist())) for i in ids], pa.string())]

    made = with_text(df, text_col, run, f"{names[0]} array<int>", f"{names[1]} string")
    return made.drop("ids", "decoded").withColumnsRenamed({names[0]: "ids", names[1]: "decoded"})


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    return round_trip(docs.select("doc_id", "text"), tokenizer).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids of every text of ``documents`` and of what they decode to."""
    return digest(table(spark, sf_dir, "documents"), word_bpe())
