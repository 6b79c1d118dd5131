"""BPE encoding and decoding by speculation and verification.

Words are proposed a segmentation by greedy longest match, every adjacent pair of proposed
tokens is tested for compatibility in one vectorised pass, and only the words with a failing
pair are merged exactly.

Texts are normalised and split by Python's and ``regex``'s tables.  A text with a character that
Python's tables don't have yet, or that the tokenizers library normalises otherwise (it knows
Unicode versions of its own), is normalised and split by that library.

Why the test decides: let every merge have a higher rank than the merges that made its parts
(true of trained vocabularies and checked on loading).  Then a token made by merge ``r`` exists
from the moment of rank ``r`` until its parent is made.  A segmentation into tokens that each
encode to themselves is the encoding of the word unless some merge joins the last part of one
token's partial state with the first part of the next one's while both exist; only the right
spine of the left token and the left spine of the right one matter, so pairs are independent.

The operator returns one row per input row.  A null text is the empty text; the empty text has
no tokens and decodes to the empty string.  Repeated rows give repeated results.  Texts of any
length are encoded whole.  Columns of the input other than those asked for are ignored, so
clashing names do no harm.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable
from itertools import chain, filterfalse

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from ._common import map_arrow, record_batch, runs, texts_of, without_cycle_search

_CHUNKS = 300_000  # cached chunks of one worker, words among them
_NONE = 1 << 40
_LONG = 200  # chunks beyond this length aren't cached
_NOT_SPACE = "\x1c\x1d\x1e\x1f"  # white space to str.split, but not to the pattern below
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = regex.compile(rf"[{_SPACE}]+")
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")
_GAP = "\u0400"  # between words; no symbol has it


def _cut(ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """Ids between edges, packed."""
    raw, at = ids.astype("<u4").tobytes(), (4 * edges).tolist()
    return [raw[a:z] for a, z in zip(at, at[1:])]


def normalised_otherwise() -> set[str]:
    """Characters in whose presence the library's NFC isn't Python's.

    Classes and decompositions never change once a version has them, so it is enough to see whether a
    mark moves past one of another class, and whether a composed character falls apart.
    """
    from tokenizers import normalizers

    nfc, nfd, out = normalizers.NFC().normalize_str, normalizers.NFD().normalize_str, set()
    for c in map(chr, range(0x80, 0x110000)):
        mark = unicodedata.combining(c)
        if mark:
            probe = f"a{c}\u0334" if mark > 1 else f"a\u0301{c}"
            if nfc(probe) != unicodedata.normalize("NFC", probe):
                out.add(c)
        if unicodedata.decomposition(c) and nfd(c) != (parts := unicodedata.normalize("NFD", c)):
            out |= {c, *parts}
    return out


def byte_symbols() -> dict[str, int]:
    """The usual printable stand-in of each byte, and the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class WordBpe:
    """A byte-level word BPE with an end-of-word suffix, from a tokenizers JSON file.

    Inside, a byte is one character below 256, and the last byte of a word 256 more.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.pieces[i] = token
        self.decimals = [str(i) for i in range(len(self.pieces))]
        self._special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        byte = self._byte = byte_symbols()

        def inside(token: str) -> str:
            if token.endswith(suffix) and len(token) > len(suffix):
                own = token[: -len(suffix)]
                return "".join(chr(byte[c]) for c in own[:-1]) + chr(256 + byte[own[-1]])
            return "".join(chr(byte[c]) for c in token)

        n = self.size = len(self.pieces)
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        #: left * size + right -> rank * size + result
        self._merge: dict[int, int] = {}
        sound = True
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self._merge.setdefault(x * n + y, r * n + z)
            sound = sound and self.rank[z] < 0 and max(self.rank[x], self.rank[y]) < r
            self.rank[z], self.left[z], self.right[z] = r, x, y
        #: Whether pairs decide; else every word is merged exactly.
        self.sound = sound
        keys = np.fromiter(self._merge, np.int64, len(self._merge))
        order = np.argsort(keys)
        self._keys = keys[order]
        self._ranks = np.fromiter(self._merge.values(), np.int64, len(keys))[order] // n
        inner = {i: inside(t) for t, i in vocab.items()}
        self._symbol = {s: i for i, s in inner.items() if len(s) == 1}
        self._by_symbol = np.full(512, -1, np.int64)
        for c, i in self._symbol.items():
            self._by_symbol[ord(c)] = i
        self._made = np.array([vocab[a + b] for a, b in merges], np.int64)
        valid = np.ones(n, bool)
        if sound:
            made = np.argsort(self.rank)[(self.rank < 0).sum() :]
            apart = self._compatible(self.left[made], self.right[made], top=False)
            for z, ok in zip(made.tolist(), apart.tolist()):
                valid[z] = ok and valid[self.left[z]] and valid[self.right[z]]
        self._match = ahocorasick.Automaton()
        for i, s in inner.items():
            if valid[i]:
                self._match.add_word(s, i)
        self._match.make_automaton()
        self._chunks: dict[str, bytes] = {}
        self._path = path
        self._library = None  # the tokenizers library's, once a text needs it
        self._seen: set[str] = set()  # characters outside ASCII texts, and those that the library has to see to
        self._odd = normalised_otherwise()
        #: Words proposed and words merged exactly, for tests and reports.
        self.proposed = self.merged = 0

    def _compatible(self, a: np.ndarray, b: np.ndarray, top: bool = True) -> np.ndarray:
        """Whether no merge crosses the border of each pair of tokens. ``top``: the whole tokens' own merge counts too."""
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        a, b = a.copy(), b.copy()
        a_until = np.full(len(a), 1 << 40)
        b_until = a_until.copy()
        while len(at):
            if top:
                key = a * self.size + b
                i = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
                r = self._ranks[i]
                crossed = (self._keys[i] == key) & (r < a_until) & (r <= b_until)
                ok[at[crossed]] = False
            else:
                crossed = np.zeros(len(at), bool)
            top = True
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            at, a, b, a_until, b_until, ra, rb = (x[go] for x in (at, a, b, a_until, b_until, ra, rb))
            down = ra > rb
            a_until, b_until = np.where(down, ra, a_until), np.where(down, b_until, rb)
            a, b = np.where(down, self.right[a], a), np.where(down, b, self.left[b])
        return ok

    def exact(self, words: list[str]) -> list[bytes]:
        """Merge by rank, leftmost first: all words of about a length at once, long ones by a heap."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        order = order[: np.searchsorted(sizes[order], 64, side="right")]
        for part in np.array_split(order, max(1, len(order) // 4000)):
            if len(part):
                for i, ids in zip(part.tolist(), self._together([words[i] for i in part.tolist()], int(sizes[part].max()))):
                    out[i] = ids
        for i in np.flatnonzero(sizes > 64).tolist():
            out[i] = np.array(self._many([self._symbol[c] for c in words[i]]), "<u4").tobytes()
        return out

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pairs' merges; ``_NONE`` where there is none or an id is -1."""
        key = a * self.size + b
        i = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[i] == key) & (a >= 0) & (b >= 0), self._ranks[i], _NONE)

    def _together(self, words: list[str], width: int) -> list[bytes]:
        sizes = np.array([len(w) for w in words], np.int64)
        flat = self._by_symbol[np.frombuffer("".join(words).encode("utf-16-le"), "<u2")]
        ids = np.full((len(words), width + 1), -1, np.int64)
        ids[np.arange(width + 1) < sizes[:, None]] = flat
        ranks = self._rank_of(ids[:, :-1], ids[:, 1:])
        done = np.full_like(ids, -1)
        rows, columns = np.arange(len(words)), np.arange(width)
        while len(rows):
            at = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            best = ranks[each, at]
            if (best == _NONE).any():  # these words are done
                over = best == _NONE
                done[rows[over], : ids.shape[1]] = ids[over]
                rows, ids, ranks, at, best = rows[~over], ids[~over], ranks[~over], at[~over], best[~over]
                each = np.arange(len(rows))
                if not len(rows):
                    break
            ids[each, at] = self._made[best]
            after = columns[: ids.shape[1] - 1] + (columns[: ids.shape[1] - 1] > at[:, None])
            ids = np.take_along_axis(ids, after, axis=1)  # without the right part of the merge
            ranks = np.take_along_axis(ranks, np.minimum(after[:, :-1] + (after[:, :-1] == at[:, None]), ranks.shape[1] - 1), axis=1)
            if not ranks.shape[1]:
                done[rows, : ids.shape[1]] = ids
                break
            inside = at < ranks.shape[1]
            ranks[each[inside], at[inside]] = self._rank_of(ids[each[inside], at[inside]], ids[each[inside], at[inside] + 1])
            left = at > 0
            ranks[each[left], at[left] - 1] = self._rank_of(ids[each[left], at[left] - 1], ids[each[left], at[left]])
        return _cut(done[done >= 0], np.concatenate([[0], np.cumsum((done >= 0).sum(axis=1))]))

    def _many(self, ids: list[int]) -> list[int]:
        """For long words: a heap over a linked list."""
        n = self.size
        nxt, prv = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(key, i) for i in range(len(ids) - 1) if (key := self._merge.get(ids[i] * n + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            key, i = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] < 0 or j >= len(ids) or self._merge.get(ids[i] * n + ids[j]) != key:
                continue
            ids[i], ids[j], nxt[i] = key % n, -1, nxt[j]
            if nxt[j] < len(ids):
                prv[nxt[j]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < len(ids) and (key := self._merge.get(ids[x] * n + ids[y])) is not None:
                    heapq.heappush(heap, (key, x))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word; a word is a non-empty string without white space, in lower case."""
        if not words:
            return []
        # all words in one text of bytes, each word's last one marked
        flat = np.frombuffer("\n".join([*words, ""]).encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint16)
        gaps = flat == 10
        stop = np.flatnonzero(gaps)
        start = np.concatenate([[0], stop[:-1] + 1])
        flat[stop - 1] += 256
        flat[stop] = ord(_GAP)
        raw = flat.tobytes().decode("utf-16-le")
        self.proposed += len(words)
        if not self.sound:
            self.merged += len(words)
            return self.exact([raw[a:z] for a, z in zip(start.tolist(), stop.tolist())])
        found = np.fromiter(chain.from_iterable(self._match.iter_long(raw)), np.int64)
        end, ids = found[::2], found[1::2]
        word = np.cumsum(gaps, dtype=np.int32)[end]
        failing = np.zeros(len(words), bool)
        inner = word[1:] == word[:-1]
        pairs = ids[:-1][inner] * self.size + ids[1:][inner]
        distinct, back = np.unique(pairs, return_inverse=True)
        failing[word[1:][inner][~self._compatible(distinct // self.size, distinct % self.size)[back]]] = True
        parts = _cut(ids, np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))]))
        wrong = np.flatnonzero(failing)
        self.merged += len(wrong)
        for i, own in zip(wrong.tolist(), self.exact([raw[a:z] for a, z in zip(start[wrong].tolist(), stop[wrong].tolist())])):
            parts[i] = own
        return parts

    def _words(self, chunk: str) -> list[str]:
        """The pattern's matches; a chunk with a character that the library sees to is a match already."""
        if not self._odd.isdisjoint(chunk):
            return [chunk]
        return [chunk] if chunk.isalpha() else _WORDS.findall(chunk)

    def _is_odd(self, text: str) -> bool:
        """Whether the library has to see to one of the characters."""
        own = set(text)
        new = own - self._seen
        if new:
            self._seen |= new
            self._odd |= {c for c in new if unicodedata.category(c) == "Cn"}
        return not self._odd.isdisjoint(own)

    def _by_library(self, text: str) -> list[str]:
        """The words of a text, as the library has them."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        words = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        words = [bytes([self._byte[c] for c in w]).decode("utf-8") for w, _ in words]
        for w in words:
            self._is_odd(w)
        return words

    def _resolve(self, chunks: list[str]) -> None:
        """Find the ids of chunks; words that they are made of are chunks as well."""
        known, words, cut = self._chunks, set(), []
        for c in chunks:
            own = self._words(c)
            if len(own) == 1:
                words.add(c)
            else:
                cut.append((c, own))
                words.update([w for w in own if w not in known])
        new = list(words)
        known.update(zip(new, self.encode_words(new)))
        for c, own in cut:
            known[c] = b"".join([known[w] for w in own])

    def _pieces_of(self, text: str) -> list[str | int]:
        """Chunks without white space, and the ids of special tokens that the text spells out."""
        out: list[str | int] = []
        for k, part in enumerate(self._special.split(text) if any(t in text for t in self.special) else [text]):
            if k % 2:
                out.append(self.special[part])
                continue
            if not part.isascii():
                if self._is_odd(part):
                    out += self._by_library(part)
                    continue
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            else:
                part = part.lower()
            out += [c for c in _SPACES.split(part) if c] if any(c in part for c in _NOT_SPACE) else part.split()
        return out

    def _plain(self, text: str) -> str | None:
        """The text normalised, if white space alone cuts it into chunks: it has no special token and no character that is seen to."""
        if any(t in text for t in self.special):
            return None
        if text.isascii():
            text = text.lower()
        elif self._is_odd(text):
            return None
        else:
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        return None if any(c in text for c in _NOT_SPACE) else text

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        with without_cycle_search():
            plain = [self._plain(t) for t in texts]
            easy = iter(self._numbered([t for t in plain if t is not None]))
            rest = iter(self._joined([self._pieces_of(t) for t, p in zip(texts, plain) if p is None]))
            return [next(rest) if p is None else next(easy) for p in plain]

    def _known(self, used: Iterable[str]) -> set[str]:
        """See to it that chunks have their ids; returns those that are new."""
        if len(self._chunks) > _CHUNKS:  # what these texts use stays
            used = list(used)
            self._chunks = {c: self._chunks[c] for c in self._chunks.keys() & set(used)}
        for i in self.special.values():
            self._chunks[i] = np.array([i], "<u4").tobytes()  # type: ignore[index]
        new = set(filterfalse(self._chunks.__contains__, used))
        self._resolve(list(new))
        return new

    def _forget(self, new: set[str]) -> None:
        for c in new:
            if len(c) > _LONG:
                del self._chunks[c]

    def _joined(self, split: list[list[str | int]]) -> list[bytes]:
        if not split:
            return []
        new = self._known(chain.from_iterable(split))  # type: ignore[arg-type]
        get = self._chunks.__getitem__
        out = [b"".join(map(get, chunks)) for chunks in split]  # type: ignore[arg-type]
        self._forget(new)
        return out

    def _numbered(self, texts: list[str]) -> list[bytes]:
        """Normalised texts: Arrow cuts them and numbers the chunks, and each distinct one's ids are looked up once."""
        if not texts:
            return []
        lists = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        numbered = lists.values.dictionary_encode()
        chunks, codes = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        new = self._known(chunks)
        own = list(map(self._chunks.__getitem__, chunks))
        self._forget(new)
        size = np.fromiter(map(len, own), np.int32, len(own)) >> 2
        ids, start = np.frombuffer(b"".join(own), "<u4"), np.cumsum(size, dtype=np.int32) - size
        each = size[codes]
        upto = np.concatenate([[0], np.cumsum(each)])
        at = np.repeat(start[codes] - upto[:-1].astype(np.int32), each)
        at += np.arange(upto[-1], dtype=np.int32)
        raw, ends = ids[at].tobytes(), (4 * upto[lists.offsets.to_numpy()]).tolist()
        return [raw[a:z] for a, z in zip(ends, ends[1:])]

    def decode(self, ids: np.ndarray) -> str:
        """What the file's decoder (none) makes of ids: their pieces joined by spaces."""
        return " ".join([self.pieces[i] for i in ids.tolist()])


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The encoder of a file, once in each process."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_column(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, ``ids`` (array of int) and ``decoded``."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string"

    def make():
        bpe = load(tokenizer)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, ids = texts_of(batch.column(1)), []
            for a, b in runs(texts):
                ids += [np.frombuffer(x, "<u4") for x in bpe.encode(texts[a:b])]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]).astype(np.int32), np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32))
            return pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([bpe.decode(x) for x in ids], pa.string())], names=[id_col, "ids", "decoded"])

        return each

    return map_arrow(docs.select(id_col, text_col), make, schema)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: n_tokens and the SHA-256 of its ids and of what they decode to.

    The digests are taken where the ids are made, so neither crosses to the JVM.
    """

    def make():
        bpe = load(tokenizer)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, n, of_ids, of_text = texts_of(batch.column(1)), [], [], []
            for a, b in runs(texts):
                for raw in bpe.encode(texts[a:b]):
                    ids = np.frombuffer(raw, "<u4")
                    n.append(len(ids))
                    of_ids.append(sha(" ".join([bpe.decimals[i] for i in ids.tolist()])))
                    of_text.append(sha(bpe.decode(ids)))
            return record_batch(
                {
                    "doc_id": (batch.column(0), pa.int64()),
                    "n_tokens": (n, pa.int64()),
                    "ids_sha256": (of_ids, pa.string()),
                    "decoded_sha256": (of_text, pa.string()),
                }
            )

        return each

    return map_arrow(
        docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text"),
        make,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
