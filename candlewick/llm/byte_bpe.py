"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding.

Encoding.  A text is cut into pieces (`Pieces`, vectorised over code points) and
each distinct piece goes through `Transducer`.  The transducer reads bytes.  Its
state holds every start position whose bytes so far can still grow into a token
(a trie node), the token that ends there, and the tokens since the last decided
boundary.  Two facts about merge vocabularies make this exact: the encoding of a
prefix is a prefix path of valid tokens, and a path is valid if each pair of
neighbours is.  A token is emitted once all open positions agree on it, so output
lags input by a lookahead bounded by the longest token.  States are interned and
transitions computed on first use; once the tables reach their bound, the automaton
runs on without interning what it reaches.

Decoding.  Ids become bytes by table; `Utf8Stream` is an incremental UTF-8 state
machine that releases only complete sequences and holds an unfinished one until
the next block.

A null text is an empty text.  Texts of any length are encoded whole.  A piece
is known by a 64-bit hash within a worker; the decoded bytes of each document are
compared with the text, and a document that differed would be encoded again piece
by piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from candlewick.llm import kernels as K
from candlewick.llm.session import read

RANK_FILE = "byte_bpe_50k.tiktoken"
#: A rank file larger than this is refused, as it is broadcast.
RANK_BYTES = 64 << 20
#: Bounds of a worker's tables: transitions, checked token pairs, known pieces.
TRANSITIONS = 150_000
PAIRS = 300_000
KNOWN = 300_000
#: Bytes of text cut, encoded and decoded together.
SLICE = 2 << 20


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        # trie: node -> {byte: node}; token that ends at a node, or -1
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for t, r in ranks.items():
            node = 0
            for b in t:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = nxt
            self.token[node] = r
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.states: dict[tuple, int] = {}
        self.open: list[tuple] = []
        self.step: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.start = self._intern(((0, -1, ()),))

    def _intern(self, state: tuple) -> int:
        at = self.states.get(state)
        if at is None:
            at = self.states[state] = len(self.open)
            self.open.append(state)
        return at

    def merged(self, piece: bytes, down_to: int = 1) -> list[bytes]:
        """Merges by rank, the definition, until ``down_to`` parts are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > down_to:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int]:
        """The last merge that makes a token; a single byte, or a token that merges never make, has none: (-1, -1)."""
        got = self.halves.get(token)
        if got is None:
            t = self.bytes_of[token]
            parts = self.merged(t, 2) if len(t) > 1 else []
            got = self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
        return got

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left`` (-1: nothing) in an encoding.

        Undoes the merges of both sides, the later one first, along the border: the pair holds
        unless two parts that face each other merge before the one that absorbed them.
        """
        if left < 0:
            return len(self.bytes_of[right]) == 1 or self._halves(right)[0] >= 0
        key = left << 24 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        if len(self.bytes_of[right]) > 1 and self._halves(right)[0] < 0:
            return False
        ranks, names = self.ranks, self.bytes_of
        limit = 1 << 62
        while True:
            together = ranks.get(names[left] + names[right])
            if together is not None and together < limit:
                return False
            a, b = self._halves(left)[1], self._halves(right)[0]
            if a < 0 and b < 0:
                return True
            if b < 0 or (a >= 0 and left > right):
                limit, left = left, a
            else:
                # at equal rank the left border of the right side wins: merges run from the left
                limit, right = right + 1, b

    def _advance(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        grown, born = [], None
        for node, last, path in self.open[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            t = self.token[child]
            if t >= 0 and born is None and self.fits(last, t):
                born = (0, t, (*path, t))
            if self.children[child]:
                grown.append((child, last, path))
        if born is None:
            raise ValueError("the rank file lacks a single byte")
        grown.append(born)
        sure = 0
        shortest = min(len(p) for _, _, p in grown)
        first = grown[0][2]
        while sure < shortest and all(p[sure] == first[sure] for _, _, p in grown):
            sure += 1
        out = first[:sure]
        entry = (self._intern(tuple((n, last, p[sure:]) for n, last, p in grown)), out)
        self.step[state << 8 | byte] = entry
        return entry

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, step, out = self.start, self.step, []
        for k, b in enumerate(piece):
            entry = step.get(state << 8 | b)
            if entry is None:
                if len(step) >= TRANSITIONS:
                    return out + self._simulate(state, piece[k:])
                entry = self._advance(state, b)
            state = entry[0]
            if entry[1]:
                out += entry[1]
        out += self.open[state][-1][2]
        return out

    def _simulate(self, state: int, rest: bytes) -> list[int]:
        """The same automaton from ``state`` on without interning what it reaches: for full tables."""
        children, token, fits = self.children, self.token, self.fits
        # a path is (token, path before it); the paths of the open state go in front
        live = []
        for node, last, path in self.open[state]:
            link = None
            for t in path:
                link = (t, link)
            live.append((node, last, link))
        for b in rest:
            grown, born = [], None
            for node, last, link in live:
                child = children[node].get(b)
                if child is None:
                    continue
                if born is None and token[child] >= 0 and fits(last, token[child]):
                    born = (0, token[child], (token[child], link))
                if children[child]:
                    grown.append((child, last, link))
            grown.append(born)
            live = grown
        out, link = [], live[-1][2]
        while link is not None:
            out.append(link[0])
            link = link[1]
        return out[::-1]


def _classes() -> np.ndarray:
    """Per code point: 1 letter, 2 number, 3 white space, 0 anything else."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for k, what in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\p{White_Space}+")):
        for m in regex.finditer(what, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            if b - a == m.end() - m.start() - 1:
                out[a : b + 1] = k
            else:
                out[[ord(c) for c in m.group()]] = k
    return out


class Pieces:
    """Cuts texts as public_tokenizers.PATTERN does, all texts of a slice at once.

    Runs of one class are pieces.  Of white space before other characters, the last
    character is a piece of its own or, if a blank, joins what follows.  A lone
    apostrophe that follows no blank takes one of the endings s t re ve m ll d.
    """

    def __init__(self) -> None:
        self.classes = _classes()

    def __call__(self, s: K.TextSlice) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts of the pieces (and the end of the last), pieces before each text."""
        n_bytes = len(s.buf)
        if not n_bytes:
            return np.zeros(1, np.int64), np.zeros(s.n + 1, np.int64)
        lead = (s.buf & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        cps = np.frombuffer(s.buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        n = len(cps)
        cls = self.classes[cps]
        heads = np.searchsorted(at, s.offsets)  # code points before each text
        begins = heads[:-1][np.diff(heads) > 0]
        cut = np.empty(n + 1, bool)
        cut[0] = True
        cut[1:n] = cls[1:] != cls[:-1]
        cut[begins] = True
        cut[n] = True
        runs = np.flatnonzero(cut)
        starts, ends = runs[:-1], runs[1:]
        text_end = np.zeros(n + 1, bool)
        text_end[heads] = True
        blank = (cls[starts] == 3) & ~text_end[ends]
        last = ends[blank] - 1
        cut[last] = True
        joined = last[cps[last] == 32] + 1
        cut[joined] = False
        # contractions
        alone = (cls[starts] == 0) & (ends - starts == 1) & (cps[starts] == 39) & ~text_end[ends]
        quote = starts[alone]
        quote = quote[cut[quote] & (cls[np.minimum(quote + 1, n - 1)] == 1)]
        if len(quote):
            stop = np.searchsorted(runs, quote + 1, "right")
            stop = runs[stop]
            one = cps[quote + 1]
            two = np.where(quote + 2 < stop, cps[np.minimum(quote + 2, n - 1)], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            for which, k in ((short, 1), (long & ~short, 2)):
                q = quote[which]
                cut[q + 1] = False
                cut[q + 1 + k] = True
        pieces = np.flatnonzero(cut)
        bounds = np.append(at, n_bytes)[pieces]
        return bounds, np.searchsorted(pieces[:-1], heads)


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, raw: bytes):
        self.transducer = Transducer(parse_ranks(raw))
        self.pieces = Pieces()
        self.known: dict[int, bytes] = {}
        top = max(self.transducer.bytes_of) + 1
        parts = [self.transducer.bytes_of.get(i, b"") for i in range(top)]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(parts), np.uint8)

    def encode(self, s: K.TextSlice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the slice, and ids before each text."""
        bounds, before = self.pieces(s)
        if len(bounds) < 2:
            return np.zeros(0, np.uint32), np.zeros(s.n + 1, np.int64)
        names = K.SpanHash(K.BYTE_WORDS[s.buf])(bounds[:-1], bounds[1:])
        unique, first, inverse = np.unique(names, return_index=True, return_inverse=True)
        known, keys = self.known, unique.tolist()
        found = list(map(known.get, keys))
        encode = self.transducer.encode
        missing = [k for k, v in enumerate(found) if v is None]
        if missing:
            if len(known) + len(missing) > KNOWN:
                known.clear()
            at = first[missing]
            raw = s.buf.tobytes()
            for k, a, b in zip(missing, bounds[at].tolist(), bounds[at + 1].tolist()):
                found[k] = known[keys[k]] = np.array(encode(raw[a:b]), "<u4").tobytes()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        flat = np.frombuffer(b"".join(found), "<u4")
        begin = np.cumsum(sizes) - sizes
        many = sizes[inverse]
        ids = flat[K.spread(begin[inverse], many)]
        sums = np.zeros(len(many) + 1, np.int64)
        np.cumsum(many, out=sums[1:])
        return ids, sums[before]

    def encode_text(self, text: bytes) -> np.ndarray:
        """One text, each piece by itself."""
        s = next(K.slices(pa.array([text], pa.binary())))
        bounds = self.pieces(s)[0].tolist()
        return np.array([i for a, b in zip(bounds, bounds[1:]) for i in self.transducer.encode(text[a:b])], "<u4")

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a block of ids."""
        return self.flat[K.spread(self.starts[ids], self.sizes[ids])]


class Utf8Stream:
    """Incremental UTF-8: `feed` returns the complete sequences, the tail waits in `state`."""

    #: state: bytes still wanted; a lead byte sets it, a continuation byte lowers it
    WANTED = np.zeros(256, np.int8)
    WANTED[0xC2:0xE0] = 1
    WANTED[0xE0:0xF0] = 2
    WANTED[0xF0:0xF5] = 3

    def __init__(self) -> None:
        self.tail = b""

    def feed(self, block: bytes) -> str:
        block = self.tail + block
        cut = len(block)
        for back in range(1, min(3, len(block)) + 1):
            b = block[-back]
            if b & 0xC0 != 0x80:
                if self.WANTED[b] >= back:
                    cut = len(block) - back
                break
        self.tail = block[cut:]
        return block[:cut].decode("utf-8")

    def end(self) -> None:
        if self.tail:
            raise ValueError("the stream ends inside a character")


def decode_stream(codec: Codec, blocks: Iterator[np.ndarray]) -> Iterator[str]:
    """Text of blocks of ids, each as soon as its characters are complete."""
    stream = Utf8Stream()
    for ids in blocks:
        yield stream.feed(codec.decode(ids).tobytes())
    stream.end()


def worker_codec(raw: bytes) -> Codec:
    return K.built(hashlib.sha256(raw).hexdigest(), lambda: Codec(raw))


def rank_bytes(path: str) -> bytes:
    raw = open(path, "rb").read()
    if len(raw) > RANK_BYTES:
        raise ValueError(f"{path} holds more than {RANK_BYTES} bytes")
    return raw


#: Ids decoded at a time.
BLOCK = 1 << 16


def tokenised(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """docs' doc_id with n_tokens, digests of ids and of the decoded bytes, and with ``with_ids`` the ids themselves."""
    shipped = docs.sparkSession.sparkContext.broadcast(rank_bytes(path))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(shipped.value)
        for batch in batches:
            for s in K.slices(batch.column(1), SLICE):
                ids, before = codec.encode(s)
                texts = [ids[a:b] for a, b in zip(before[:-1].tolist(), before[1:].tolist())]
                id_names, byte_names = [], []
                for i, own in enumerate(texts):
                    raw = s.text(i)
                    if not (decoded := "".join(decode_stream(codec, (own[k : k + BLOCK] for k in range(0, len(own), BLOCK)))).encode()) == raw:
                        own = texts[i] = codec.encode_text(raw)
                        decoded = codec.decode(own).tobytes()
                    id_names.append(hashlib.sha256(np.ascontiguousarray(own, "<u4")).hexdigest())
                    byte_names.append(hashlib.sha256(decoded).hexdigest())
                columns = [batch.column(0).slice(s.first, s.n), pa.array([len(t) for t in texts], pa.int64()), pa.array(id_names, pa.string()), pa.array(byte_names, pa.string())]
                if with_ids:
                    offsets = np.zeros(s.n + 1, np.int32)
                    np.cumsum([len(t) for t in texts], out=offsets[1:])
                    flat = np.concatenate(texts).astype(np.int32) if texts else np.zeros(0, np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names=names)
        K.give_back()

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(read(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE))
