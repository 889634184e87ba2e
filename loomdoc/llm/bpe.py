"""Byte-pair encoding of whole texts and its decoding, with a public vocabulary file.

Encoding goes word by word.  The distinct new words of a piece of a batch make a trie
of byte signs, whose nodes are visited depth first.  The state of a node is the last token of its
prefix's encoding: the one token that ends the prefix and stays apart from the last token of what is
before it.  A prefix that words share is so encoded once, whatever the number of words; a word's tokens are read
back from the states along its path.  That this is the encoding by merges in order of rank follows from
two facts: the encoding of a prefix that ends with a token is that of what is before it and the token, and
a row of tokens is an encoding if every two neighbours are one.  Two neighbours are one unless
a merge across their border comes before the merges that use up its sides.

Nothing is shuffled: each task keeps the words that it has met lately, up to about four times CACHE_BYTES.  Long texts are cut at spaces, as no token has one.

Rows: a null or empty text has no tokens; ids, ties and repeated rows do not matter, as rows are
encoded one by one; an empty table gives an empty one; other columns stay, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Code points of text that are split into words before their new words are encoded, and at most in a stretch of a longer text.
PIECE_CHARS = 1 << 20
#: Estimated bytes of the chunks, and of the words, that a task remembers as the last ones; as many again may be older.
CACHE_BYTES = 24 << 20
#: ASCII signs that are no letters, digits or spaces.
SIGNS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
#: Signs of a word beyond which it shares no states with its neighbours.
LONG_WORD = 63
#: Bytes of results in a batch.
BATCH_BYTES = 8 << 20
_NEVER = 1 << 62


def vocabulary_path() -> str:
    """The installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_signs() -> list[str]:
    """The printable sign of each byte in byte-level vocabularies: itself if it is printable, else the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merges:
    """Tokens and merges of a vocabulary: which token ends a prefix, and which tokens stay apart."""

    def __init__(self, ids: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.ids, self.suffix = ids, suffix
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> left, right, rank
        for k, (a, b) in enumerate(merges):
            left, right, whole = ids[a], ids[b], ids[a + b]
            if whole in self.parts:
                raise ValueError(f"two merges make {a + b!r}")
            self.rank[left, right] = k
            self.parts[whole] = left, right, k
        self.length = {t: len(s.removesuffix(suffix)) for s, t in ids.items()} if suffix else {t: len(s) for s, t in ids.items()}
        # Tokens that merges in order of rank do not make of their own signs never occur.
        self.stable: dict[int, bool] = {}
        for s, t in ids.items():
            if t not in self.parts:
                self.stable[t] = self.length[t] == 1
        for t, (left, right, k) in sorted(self.parts.items(), key=lambda x: x[1][2]):
            self.stable[t] = self.stable[left] and self.stable[right] and not self.crossed(left, right, k)
        self.usable = {s: t for s, t in ids.items() if self.stable[t]}

    def crossed(self, first: int, second: int, before: int = _NEVER) -> bool:
        """Whether a merge of a rank below `before` crosses the border of two tokens while its sides are there; of equal merges the left one is first."""
        x, until_x = first, before
        while True:
            y, until_y = second, before
            while True:
                k = self.rank.get((x, y), before)
                if k < until_x and k <= until_y:
                    return True
                if y not in self.parts:
                    break
                y, _, k = self.parts[y]
                until_y = min(k, before)
            if x not in self.parts:
                return False
            _, x, k = self.parts[x]
            until_x = min(k, before)


class Candidates(dict):
    """Text -> its suffixes that are tokens, the longest first, as (length, token); filled when asked."""

    def __init__(self, merges: Merges, end: str):
        self.merges, self.end = merges, end

    def __missing__(self, text: str) -> tuple[tuple[int, int], ...]:
        found = [(k, self.merges.usable.get(text[-k:] + self.end)) for k in range(len(text), 0, -1)]
        out = self[text] = tuple((k, t) for k, t in found if t is not None)
        return out


class TrieEncoder:
    """Encodes words of byte signs; what it knows of pairs of tokens stays."""

    MOST_PAIRS = 1 << 17

    def __init__(self, merges: Merges):
        self.merges, self.apart = merges, {}
        self.heads = {"", *(s[:k] for s in merges.usable for k in range(1, len(s) + 1))}
        self.plain, self.ends = Candidates(merges, ""), Candidates(merges, merges.suffix)

    def _stay_apart(self, before: int, token: int) -> bool:
        if len(self.apart) >= self.MOST_PAIRS:
            self.apart.clear()
        out = self.apart[before << 32 | token] = before >= 0 and not self.merges.crossed(before, token)
        return out

    def _end(self, tail: str, depth: int, last: list[int], found: Candidates) -> int:
        """The last token of a prefix that ends with tail, from the last tokens of the shorter ones; -1 if no token fits."""
        for k, token in found[tail]:
            if k == depth:
                return token
            apart = self.apart.get(last[depth - k] << 32 | token)
            if apart is None:
                apart = self._stay_apart(last[depth - k], token)
            if apart:
                return token
        return -1

    def encode(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Tokens of each distinct word.

        The trie is laid out as its words in order, each with the length of the prefix that it shares with the one before: a word's nodes
        are the depths beyond.  Word after word its nodes come depth first, and the states up to the shared depth are there.
        """
        heads, plain, suffix, length = self.heads, self.plain, self.merges.suffix, self.merges.length
        words = sorted(words)
        last, tails = [-1], [""]  # by depth: the last token, and the longest end that is the head of a token
        for word, shared_signs in zip(words, neighbours(words), strict=True):
            n = len(word) - 1 if suffix else len(word)
            del last[shared_signs + 1 :], tails[shared_signs + 1 :]
            tail = tails[-1]
            for depth in range(len(last), n + 1):
                tail += word[depth - 1]
                while tail not in heads:
                    tail = tail[1:]
                tails.append(tail)
                last.append(self._end(tail, depth, last, plain))
            if suffix:
                tail = tails[n] + word[n]
                while tail and tail + suffix not in heads:
                    tail = tail[1:]
                token, at = self._end(tail, n + 1, last, self.ends), n + 1
            else:
                token, at = last[n], n
            out = []
            while at > 0:
                if token < 0:
                    raise ValueError("the vocabulary lacks a byte")
                out.append(token)
                at -= length[token]
                token = last[at]
            yield word, out[::-1]


def neighbours(words: list[str]) -> np.ndarray:
    """Signs at the head of each word that the one before it has too, without the last sign of either; 0 after or at a long word."""
    out = np.zeros(len(words), dtype=np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for low in range(0, len(words), 1 << 14):
        part = slice(max(low - 1, 0), low + (1 << 14))
        short = sizes[part] <= LONG_WORD
        table = np.array([w if ok else "" for w, ok in zip(words[part], short, strict=True)], dtype=f"U{LONG_WORD + 1}").view(np.uint32).reshape(len(short), -1)
        same = (table[1:] != table[:-1]).argmax(axis=1)
        least = np.minimum(sizes[part][1:], sizes[part][:-1]) - 1
        out[part.start + 1 : part.start + len(short)] = np.where(short[1:] & short[:-1], np.minimum(same, np.maximum(least, 0)), 0)
    return out


class Vocabulary:
    """A tokenizer file of byte signs: words by a pattern after normalising, then merges, with or without a sign for a word's end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.file = file.read()
        spec = json.loads(self.file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout") or spec.get("decoder"):
            raise ValueError("only plain byte-pair vocabularies whose tokens are joined by spaces")
        split, level = (spec["pre_tokenizer"] or {}).get("pretokenizers", [None, None])
        if split is None or split["type"] != "Split" or split["behavior"] != "Removed" or not split["invert"] or level["type"] != "ByteLevel" or level["add_prefix_space"] or level["use_regex"]:
            raise ValueError("words are the matches of a pattern")
        if [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("texts are composed, their spaces made equal, and lower-cased")
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError("special tokens are matched as they stand")
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.pattern = split["pattern"]["Regex"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.merges = Merges(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.names = {t: s for s, t in (model["vocab"] | self.special).items()}


class Splitter:
    """Words of a text as the installed library finds them.

    Texts of calm signs are split by the pattern itself: signs that stand alone, cannot be composed, and are lower-cased and split
    here as by the library, which is asked once for each sign.  All other texts go through the library's own normaliser and splitter.
    """

    def __init__(self, vocabulary: Vocabulary):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary.file)
        self.find = regex.compile(vocabulary.pattern).findall
        self.signs = byte_signs()
        self.bytes = {s: b for b, s in enumerate(self.signs)}
        self.calm: set[str] = set()
        self.odd: set[str] = set()
        # Whether the pattern takes runs of letters and single signs so; it is asked about, like the signs, and not assumed.
        letters = "".join(map(chr, range(97, 123)))
        self.letters = self._slow(letters.upper()) == [letters] and all(self._slow(f"Ab{x} tx{x}") == ["ab", x, "tx", x] for x in SIGNS)

    def _slow(self, text: str) -> list[str]:
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.bytes[s] for s in word).decode() for word, _ in found]

    def _is_calm(self, sign: str) -> bool:
        point = ord(sign)
        if unicodedata.category(sign)[0] == "M" or unicodedata.combining(sign) or not unicodedata.is_normalized("NFC", sign) or sign == "Σ":
            return False
        if 0x1100 <= point <= 0x11FF or 0xA960 <= point <= 0xA97F or 0xD7B0 <= point <= 0xD7FF:  # parts of Hangul syllables compose
            return False
        sample = f"a{sign}b1{sign}c1!{sign}! {sign} {sign}{sign}'{sign}s"
        return self.find(sample.lower()) == self._slow(sample)

    def __call__(self, text: str) -> list[str]:
        if self.letters and text.isascii():
            # Letters alone are one word; a sign that is no letter, digit or space behind them is another one.
            if text.isalpha():
                return [text.lower()]
            if text[:-1].isalpha() and text[-1] in SIGNS:
                return [text[:-1].lower(), text[-1]]
        new = set(text) - self.calm
        if new:
            for sign in new - self.odd:
                (self.calm if self._is_calm(sign) else self.odd).add(sign)
            if new & self.odd:
                return self._slow(text)
        return self.find(text.lower())

    def spelled(self, word: str) -> str:
        """The byte signs of a word."""
        return word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(self.signs)


def stretches(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """A text in stretches of about limit code points, cut before a space or line end; a longer run without one stays whole."""
    at, n = 0, len(text)
    while n - at > limit:
        ends = [x for x in (text.find(" ", at + limit), text.find("\n", at + limit)) if x >= 0]
        if not ends:
            break
        yield text[at : min(ends)]
        at = min(ends)
    yield text[at:]


class Known:
    """Bytes by text: those of the last pieces that were asked for; once they are many, what no later piece asks for is forgotten."""

    def __init__(self):
        self.young, self.old, self.held = {}, {}, 0

    def put(self, key: str, data: bytes) -> None:
        self.young[key] = data
        self.held += 150 + 2 * len(key) + len(data)

    def missing(self, keys: set[str]) -> set[str]:
        """The keys that are not known; the others are young then, until missing is called again."""
        if self.held > CACHE_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        keys -= self.young.keys()
        for key in keys & self.old.keys():
            self.put(key, self.old[key])
        return keys - self.old.keys()


class Encoder:
    """Texts to the bytes of their ids (little-endian, 32 bits).

    A text is cut at spaces into chunks, as no token has a space; chunks and words that a task has met are not looked at again.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.split = vocabulary, Splitter(vocabulary)
        self.trie, self.chunks, self.words = TrieEncoder(vocabulary.merges), Known(), Known()
        self.special = re.compile("(" + "|".join(re.escape(x) for x in sorted(vocabulary.special, key=len, reverse=True)) + ")") if vocabulary.special else None

    def _parts(self, text: str) -> Iterator[list[str] | bytes]:
        """Chunks of the stretches between special tokens, and the bytes of these."""
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                yield np.array([self.vocabulary.special[part]], dtype="<u4").tobytes()
            elif part:
                for stretch in stretches(part):
                    yield stretch.replace("\n", " ").replace("\t", " ").split(" ")

    def _learn(self, runs: list[list[str]]) -> None:
        new = {chunk: self.split(chunk) for chunk in self.chunks.missing(set().union(*runs))}
        spelled = {self.split.spelled(w): w for w in self.words.missing(set().union(*new.values()))}
        for signs, ids in self.trie.encode(spelled):
            self.words.put(spelled[signs], struct.pack(f"<{len(ids)}I", *ids))
        words = self.words.young
        for chunk, own in new.items():
            self.chunks.put(chunk, words[own[0]] if len(own) == 1 else b"".join([words[w] for w in own]))

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text."""
        waiting: list[tuple[int, list[str] | bytes]] = []  # (text, chunks or ready bytes)
        size, done, parts = 0, 0, []

        def flush() -> None:
            self._learn([x for _, x in waiting if isinstance(x, list)])
            for k, x in waiting:
                while len(parts) <= k - done:
                    parts.append([])
                parts[k - done].append(x if isinstance(x, bytes) else b"".join(map(self.chunks.young.__getitem__, x)))
            waiting.clear()

        k = -1
        for k, text in enumerate(texts):
            for x in self._parts(text or ""):
                waiting.append((k, x))
                size += 4 * len(x) if isinstance(x, list) else 4
                if size >= PIECE_CHARS:
                    flush()
                    size = 0
            if not waiting:  # all of this text is encoded
                for j in range(k + 1 - done):
                    yield b"".join(parts[j]) if j < len(parts) else b""
                parts.clear()
                done = k + 1
        flush()
        for j in range(k + 1 - done):
            yield b"".join(parts[j]) if j < len(parts) else b""


def _batches(batches: Iterator[pa.RecordBatch], column: str, name: str, kind: pa.DataType, results) -> Iterator[pa.RecordBatch]:
    """Each batch with one more column, in batches of about BATCH_BYTES of it."""
    for batch in batches:
        low, out, size = 0, [], 0
        for value in results(x.as_py() for x in batch.column(column)):
            out.append(value)
            size += 0 if value is None else len(value)
            if size >= BATCH_BYTES:
                yield batch.slice(low, len(out)).append_column(name, pa.array(out, type=kind))
                low, out, size = low + len(out), [], 0
        if out or not batch.num_rows:
            yield batch.slice(low, len(out)).append_column(name, pa.array(out, type=kind))


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with n_tokens and ids, the token ids of the text as little-endian 32-bit numbers."""
    sent = shared.Sent(docs.sparkSession, Vocabulary(path or vocabulary_path()))
    docs, back = shared.plain(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent())
        yield from _batches(batches, "text", "ids", pa.binary(), encoder.encode)

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    found = docs.mapInArrow(run, f"{names}, ids binary")
    return back(found.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long")), "n_tokens", "ids")


def decoded(docs: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """docs with decoded, the names of the tokens with a space between them; null where ids are null."""
    sent = shared.Sent(docs.sparkSession, Vocabulary(path or vocabulary_path()).names)
    docs, back = shared.plain(docs, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent()
        get = [names.get(k, "") for k in range(max(names, default=-1) + 1)].__getitem__
        texts = lambda column: (None if x is None else " ".join(map(get, np.frombuffer(x, dtype="<u4").tolist())) for x in column)
        yield from _batches(batches, ids, "decoded", pa.string(), texts)

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return back(docs.mapInArrow(run, f"{names}, decoded string"), "decoded")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: number of tokens, and hashes of the ids and of the text that decoding them gives."""
    found = decoded(encoded(docs.select("doc_id", "text"), path).select("doc_id", "n_tokens", "ids"), path=path)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
