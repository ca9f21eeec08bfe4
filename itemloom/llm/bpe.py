"""Operator 6, BPE encoding and decoding by a pair occurrence index.

All different pre-tokens of a batch lie end to end in one symbol array.  An
index maps each mergeable pair (by its rank) to all its positions.  Active
ranks are taken in ascending order; each one is applied to all its positions
at once, and the pairs that a merge makes with its neighbours join the lists
of their own ranks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .words import Words, chunks, ranges, text_buffers

#: Bytes that a worker remembers of pieces it has encoded; beyond it all are forgotten.
REMEMBERED_BYTES = 128 << 20
#: Bytes of a remembered piece beside its ids and decoded text (a place in the dictionary, its hash, two ends).
ENTRY_BYTES = 150
#: Text handled at once; longer texts go through in parts cut at white space.
SLICE_BYTES = 2 << 20
#: Different pieces encoded at once.
BATCH_PIECES = 50_000
BLANK = regex.compile(rb"[\x20\x09-\x0D]+")
#: Characters for which the quick path splits and folds exactly as the library does; others take the library's own steps.
PLAIN = regex.compile(r"[\x00-ԯḀ-῿ -⁤₠-₿぀-ゖ゠-ヿ一-龥가-힣]*")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PairIndexBPE:
    """Merges of a tokenizer file applied to many pre-tokens together."""

    def __init__(self, file: bytes | str):
        """``file`` is a tokenizer file's content, or its path."""
        from tokenizers import Tokenizer

        if isinstance(file, str):
            with open(file, "rb") as source:
                file = source.read()
        spec = json.loads(file)
        self.library = Tokenizer.from_buffer(file)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: s.encode() for s, i in vocab.items()} | {i: s.encode() for s, i in self.added.items()}
        #: every id's name with a space after it, end to end: that of id i is named[upto[i] : upto[i + 1]]
        spaced = [names[i] + b" " if i in names else b"" for i in range(max(names) + 1)]
        self.named, self.upto = np.frombuffer(b"".join(spaced), np.uint8), np.cumsum([0, *map(len, spaced)])
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self.final = np.array([vocab[letters[b] + suffix] for b in range(256)], dtype=np.int64)
        self.width = np.int64(len(spaced) + 1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        key = left * self.width + right
        self.rank = np.argsort(key, kind="stable")
        self.key = key[self.rank]
        self.split_added = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.unletter = {c: b for b, c in letters.items()}
        self.forget()

    def forget(self) -> None:
        """No pieces are known: numbers by hash, and, end to end by number, their ids and decoded text."""
        self.number: dict[int, int] = {}
        self.ids, self.text = bytearray(), bytearray()
        self.ids_end, self.text_end = array("q", [0]), array("q", [0])

    def held(self) -> int:
        return len(self.number) * ENTRY_BYTES + len(self.ids) + len(self.text)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none."""
        k = a * self.width + b
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where((self.key[at] == k) & (a >= 0) & (b >= 0), self.rank[at], -1)

    def encode_tokens(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens (non-empty UTF-8 bytes) end to end, where each one's end)."""
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        lens = np.array([len(t) for t in tokens], dtype=np.int64)
        n = len(data)
        end = np.cumsum(lens)
        sym = np.full(n + 1, -1, dtype=np.int64)
        sym[:n] = self.inner[data]
        sym[end - 1] = self.final[data[end - 1]]
        nxt = np.arange(1, n + 2, dtype=np.int64)
        nxt[end - 1] = n
        nxt[n] = n
        prv = np.arange(-1, n, dtype=np.int64)
        prv[end - lens] = n
        prv[n] = n
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(pos: np.ndarray) -> None:
            r = self.ranks(sym[pos], sym[nxt[pos]])
            found = r >= 0
            pos, r = pos[found], r[found]
            if not len(pos):
                return
            order = np.argsort(r, kind="stable")
            pos, r = pos[order], r[order]
            cut = np.flatnonzero(np.diff(r)) + 1
            begin = [0, *cut.tolist()]
            for rank, b, e in zip(r[begin].tolist(), begin, [*begin[1:], len(r)], strict=True):
                if rank in lists:
                    lists[rank].append(pos[b:e])
                else:
                    lists[rank] = [pos[b:e]]
                    heapq.heappush(active, rank)

        note(np.arange(n))
        while active:
            rank = heapq.heappop(active)
            got = lists.pop(rank)
            pos = np.unique(np.concatenate(got))
            a, b = self.left[rank], self.right[rank]
            pos = pos[(sym[pos] == a) & (sym[nxt[pos]] == b)]
            if a == b and len(pos) > 1:
                linked = np.zeros(len(pos), dtype=bool)
                linked[1:] = nxt[pos[:-1]] == pos[1:]
                head = np.maximum.accumulate(np.where(linked, 0, np.arange(len(pos))))
                pos = pos[(np.arange(len(pos)) - head) % 2 == 0]
            if not len(pos):
                continue
            gone = nxt[pos]
            after = nxt[gone]
            sym[pos] = self.made[rank]
            sym[gone] = -2
            nxt[pos] = after
            prv[after] = pos
            prv[n] = n
            before = prv[pos]
            note(np.concatenate([pos[after < n], before[before < n]]))
        alive = sym[:n] >= 0
        return sym[:n][alive], np.cumsum(alive)[end - 1]

    def pretokens(self, piece: str) -> list[bytes]:
        """Pre-tokens of a piece without added tokens, as UTF-8 bytes."""
        if PLAIN.fullmatch(piece):
            folded = unicodedata.normalize("NFC", piece)
            folded = "".join([c.lower() for c in folded]) if "Σ" in folded else folded.lower()
            return [t.encode() for t in self.pattern.findall(folded)]
        folded = self.library.normalizer.normalize_str(piece)
        return [bytes([self.unletter[c] for c in t]) for t, _ in self.library.pre_tokenizer.pre_tokenize_str(folded)]

    def parts(self, piece: bytes) -> list[bytes | int]:
        """Pre-tokens, and ids of added tokens, of a piece of raw text."""
        text = piece.decode()
        if not self.split_added or not self.split_added.search(text):
            return list(self.pretokens(text))
        out: list[bytes | int] = []
        at = 0
        for m in self.split_added.finditer(text):
            out += [*self.pretokens(text[at : m.start()]), self.added[m.group()]]
            at = m.end()
        return out + self.pretokens(text[at:])

    def learn(self, pieces: list[bytes]) -> None:
        """Append the ids and the decoded text (each name with a space after it) of pieces not known yet."""
        for i in range(0, len(pieces), BATCH_PIECES):
            split = [self.parts(p) for p in pieces[i : i + BATCH_PIECES]]
            known: dict[bytes | int, int] = {}
            used = np.array([known.setdefault(t, len(known)) for ps in split for t in ps], dtype=np.int64)
            tokens = [t for t in known if isinstance(t, bytes)]
            ids, end = self.encode_tokens(tokens)
            added = [t for t in known if isinstance(t, int)]
            place = np.empty(len(known), np.int64)
            place[[known[t] for t in tokens]], place[[known[t] for t in added]] = np.arange(len(tokens)), len(tokens) + np.arange(len(added))
            ids, end = np.concatenate([ids, np.array(added, np.int64)]), np.concatenate([[0], end, len(ids) + 1 + np.arange(len(added))])
            used = place[used]
            ids_of = ids[ranges(end[used], end[used + 1])]
            last = np.cumsum([0, *map(len, split)])  # parts up to each piece
            count = np.concatenate([[0], np.cumsum(end[used + 1] - end[used])])[last]
            width = np.concatenate([[0], np.cumsum(self.upto[ids_of + 1] - self.upto[ids_of])])[count]
            self.ids_end.frombytes((self.ids_end[-1] + count[1:]).tobytes())
            self.text_end.frombytes((self.text_end[-1] + width[1:]).tobytes())
            self.ids += ids_of.astype("<u4").tobytes()
            self.text += self.named[ranges(self.upto[ids_of], self.upto[ids_of + 1])].tobytes()

    def numbers(self, words: Words) -> np.ndarray:
        """The number of each piece; those that are new are learnt.  Pieces are told apart by a 64-bit hash."""
        h, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        known = self.number
        new = [i for i, x in enumerate(h.tolist()) if x not in known]
        begin = len(self.ids_end) - 1
        self.learn([words.raw[a:b].tobytes() for a, b in zip(words.starts[first[new]], words.ends[first[new]], strict=True)])
        known.update(zip(h[new].tolist(), range(begin, begin + len(new)), strict=True))
        return np.array([known[x] for x in h.tolist()], dtype=np.int64)[back]

    def encode(self, raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded UTF-8) of each text."""
        if self.held() > REMEMBERED_BYTES:
            self.forget()
        words = Words(raw, off)
        piece = self.numbers(words) if len(words) else np.zeros(0, np.int64)
        out = []
        for kind, flat, end in (("<u4", self.ids, self.ids_end), (np.uint8, self.text, self.text_end)):
            edge = np.frombuffer(end, np.int64)
            lo, hi = edge[piece], edge[piece + 1]
            upto = np.concatenate([[0], np.cumsum(hi - lo)])[words.first]
            out.append((np.frombuffer(flat, kind)[ranges(lo, hi)] if len(piece) else np.zeros(0, kind), upto))
            del edge, lo, hi
        (ids, at), (text, to) = out
        for d in range(words.n_docs):
            yield ids[at[d] : at[d + 1]].tobytes(), text[to[d] : max(to[d], to[d + 1] - 1)].tobytes()


_LOADED: dict[str, PairIndexBPE] = {}


def loaded(file: bytes) -> PairIndexBPE:
    """The worker's tokenizer for a file's content; kept while the worker lives."""
    name = hashlib.sha256(file).hexdigest()
    if name not in _LOADED:
        _LOADED[name] = PairIndexBPE(file)
    return _LOADED[name]


def parts_of(text: bytes, limit: int) -> Iterator[bytes]:
    """The text in parts of about ``limit`` bytes, cut at white space alone."""
    lo = 0
    while len(text) - lo > limit:
        cut = BLANK.search(text, lo + limit)
        if cut is None:
            break
        yield text[lo : cut.start()]
        lo = cut.end()
    yield text[lo:]


class Digested:
    """Of one text: number of ids and the digests of ids and decoded text, fed part by part."""

    def __init__(self, whole: bool):
        self.n, self.some = 0, False
        self.ids, self.text = hashlib.sha256(), hashlib.sha256()
        self.kept: tuple[list[bytes], list[bytes]] | None = ([], []) if whole else None

    def feed(self, ids: bytes, text: bytes) -> None:
        if not ids:
            return
        if self.some:
            text = b" " + text
        self.some = True
        self.n += len(ids) // 4
        self.ids.update(ids)
        self.text.update(text)
        if self.kept:
            self.kept[0].append(ids)
            self.kept[1].append(text)


def encoder(file, whole: bool, extra: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Slices of whole texts of about ``SLICE_BYTES``, so memory follows bytes and not rows; a longer text goes through in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(file.value)
        for big in batches:
            raw, off = text_buffers(big.column("text"))
            for lo, hi in chunks(off, SLICE_BYTES):
                out = [Digested(whole) for _ in range(lo, hi)]
                if hi - lo == 1:
                    for part in parts_of(raw[off[lo] : off[hi]].tobytes(), SLICE_BYTES):
                        out[0].feed(*next(bpe.encode(np.frombuffer(part, np.uint8), np.array([0, len(part)]))))
                else:
                    for one, (ids, text) in zip(out, bpe.encode(raw, off[lo : hi + 1]), strict=True):
                        one.feed(ids, text)
                batch = big.slice(lo, hi - lo)
                cols = [batch.column(c) for c in extra] + [pa.array([x.n for x in out], pa.int64()), pa.array([x.ids.hexdigest() for x in out], pa.string()), pa.array([x.text.hexdigest() for x in out], pa.string())]
                names = [*extra, "n_tokens", "ids_sha256", "decoded_sha256"]
                if whole:
                    cols += [pa.array([np.frombuffer(b"".join(x.kept[0]), "<u4").astype(np.int32) for x in out], pa.list_(pa.int32())), pa.array([b"".join(x.kept[1]).decode() for x in out], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def bpe_encode(docs: DataFrame, path: str, whole: bool = False) -> DataFrame:
    """Encode every whole text, then decode the ids, as the tokenizers library does.

    ``path`` names the tokenizer's file on the driver.  Returns doc_id,
    n_tokens, ids_sha256 and decoded_sha256; with ``whole`` also the ids and
    the decoded text.

    A null or empty text has no tokens.  White space separates pieces and is
    dropped, so texts of white space alone have no tokens either.  Very long
    texts are read in parts cut at white space, which changes no token; only
    their digests grow, so memory does not follow a text's length.  A null
    doc_id stays null; repeated rows give repeated rows; an empty table gives
    an empty one; other columns are not read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if whole:
        schema += ", ids array<int>, decoded string"
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with open(path, "rb") as source:  # the driver's file; workers get its content
        file = docs.sparkSession.sparkContext.broadcast(source.read())
    return rows.mapInArrow(encoder(file, whole, ["doc_id"]), schema)
