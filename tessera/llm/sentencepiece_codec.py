"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice of pieces over a text is searched from left to right. Only a window of the length
of the longest piece matters to later characters; whenever the backpointer paths from all
positions in it run together on one boundary, what lies before is final and is committed.

Two kinds of model are searched:

* unigram: the path of greatest total score;
* BPE: the merges of a BPE model put no score on a path but forbid pairs of neighbours. A
  sequence of pieces is the model's own encoding exactly if each piece, and each two
  neighbouring pieces, encode to themselves: merges inside a piece run the same whatever
  surrounds it, so the first merge across a boundary would show in that pair alone. Each
  position thus has one last piece that survives, and the search is a Viterbi search with
  transitions of 0 or minus infinity. It gives the ids of the merging algorithm.

A boundary between two characters that no piece holds in a row is on every path. Texts are
cut there (before spaces, around line ends), each segment is searched, and the ids of segments
are remembered. Segments new to a worker are searched in order of their characters, and the
search goes back only to where one parts from the one before.
"""

from __future__ import annotations

import functools
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import session
from tessera.llm.kernel import slices, strings, tidy, turn_to

SPACE = "▁"
#: Remembered parts between spaces, segments, and pairs of a worker, at most; then it starts afresh.
CACHE = 200_000
SEGMENT_CACHE = 200_000
PAIR_CACHE = 300_000
#: Bytes of texts whose words are looked up together.
SLICE = 1 << 21
#: Characters of the longest remembered segment.
LONGEST = 64
#: Characters pushed at once; with as many not committed, the search looks for a common boundary.
STEP = 64
_RUNS = re.compile(rf"{SPACE}*[^\W\d_]+|{SPACE}+|[^\w{SPACE}]+|[\d_]+|.", re.S)


class Model:
    """Pieces, scores and searches of a SentencePiece model with the identity normaliser."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id = [0] * 256
        self.raw: list[bytes] = []
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.raw.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.raw.append(b"")
            else:
                self.raw.append(p.replace(SPACE, " ").encode())
                if not sp.is_unused(i):
                    self.id[p], self.score[p] = i, sp.get_score(i)
        self.longest = max(map(len, self.id), default=1)
        self.dummy_prefix = sp.encode("a", out_type=str)[0].startswith(SPACE)
        self.plain = self.dummy_prefix and not any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.inner = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        kind = _model_type(sp)
        self.bpe = kind == 2
        self.least = min(self.score.values(), default=0.0) - 10.0
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.segments: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        if self.bpe:  # a piece that merges never make can't be on a path
            self.reachable = {p: p for p in self.id if self.merge(p) == [p]}
        else:
            self.reachable = {p: p for p in self.id}
        self.packed = {p: struct.pack("<i", i) for p, i in self.id.items()}
        self.tuples = {p: (i,) for p, i in self.id.items()}
        self.longest_to: dict[str, int] = {}  # by a piece's last two characters
        self.longest_of: dict[str, int] = {}  # by its last three
        for p in self.reachable:
            for table, n in ((self.longest_to, 2), (self.longest_of, 3)):
                if len(p) >= n:
                    table[p[-n:]] = max(len(p), table.get(p[-n:], 0))

    def forced(self, a: str, b: str) -> bool:
        """Whether every path has a boundary between these characters."""
        return a + b not in self.inner

    def merge(self, text: str) -> list[str]:
        """Merges of a short text, best score first, then leftmost."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """BPE: whether two pieces in a row encode to themselves."""
        after = self.pairs.get(a)
        if after is None:
            after = self.pairs[a] = {}
        ok = after.get(b)
        if ok is None:
            if self.n_pairs >= PAIR_CACHE:
                self.pairs, self.n_pairs = {}, 0
                after = self.pairs[a] = {}
            self.n_pairs += 1
            ok = after[b] = a[-1] + b[0] not in self.inner or self.merge(a + b) == [a, b]
        return ok

    def ids_of(self, piece: str) -> tuple[int, ...]:
        ids = self.tuples.get(piece)
        return tuple(self.byte_id[b] for b in piece.encode()) if ids is None else ids

    def pack(self, pieces: list[str]) -> bytes:
        """Ids, 4 bytes each."""
        packed = self.packed
        return b"".join([packed[p] if p in packed else struct.pack(f"<{len(p.encode())}i", *self.ids_of(p)) for p in pieces])

    def search(self, segments: list[str]) -> list[bytes]:
        """The packed ids of pieces of text that begin and end at forced boundaries."""
        search, out = Search(self), []
        for s in segments:
            at, found = search.start(s), []
            while at < len(s):
                found += search.push_pieces(s[at : at + STEP])
                at += STEP
            out.append(self.pack(found + search.finish_pieces()))
        return out

    def learn(self, segments: set[str]) -> dict[str, bytes]:
        """The packed ids of some segments; those of at most LONGEST characters are remembered."""
        known = self.segments
        if len(known) + len(segments) > SEGMENT_CACHE:  # segments of these texts that are known already are frequent ones
            known = self.segments = {s: known[s] for s in segments if s in known}
        new = sorted(segments.difference(known))
        found = dict(zip(new, self.search(new)))
        known.update((s, x) for s, x in found.items() if len(s) <= LONGEST)
        return {s: found[s] if s in found else known[s] for s in segments}

    def _segments(self, escaped: str) -> list[str]:
        """Cut between letters, other characters and spaces, where those boundaries are forced."""
        inner = self.inner
        out: list[str] = []
        for x in _RUNS.findall(escaped):
            if out and out[-1][-1] + x[0] in inner:
                out[-1] += x
            else:
                out.append(x)
        return out

    def _cut(self, text: str) -> list[str]:
        return self._segments((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        """Ids of any text; of the empty text, none."""
        return np.frombuffer(self.encode_batch([text])[0], "<i4").tolist()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as 4-byte integers. Parts between single spaces are remembered whole."""
        split = [t.split(" ") if self.plain and t and t[0] != " " and "  " not in t and t[-1] != " " and SPACE not in t else None for t in texts]
        words = set().union(*(s for s in split if s is not None))
        parts = self.parts
        if len(parts) + len(words) > CACHE:  # words of these texts that are known already are frequent ones
            parts = self.parts = {w: parts[w] for w in words if w in parts}
        cut = {w: [SPACE + w] if w.isalpha() else self._segments(SPACE + w) for w in words.difference(parts)}
        whole = [self._cut(t) if s is None else () for s, t in zip(split, texts)]
        known = self.learn(set().union(*cut.values(), *whole))
        for w, segments in cut.items():
            parts[w] = b"".join([known[s] for s in segments])
        return [b"".join([known[x] for x in segments]) if s is None else b"".join([parts[w] for w in s]) for s, segments in zip(split, whole)]

    def decode(self, ids: list[int]) -> str:
        """The text of some ids; broken UTF-8 is replaced."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def _model_type(sp) -> int:
    """The model type of the trainer's settings: 1 unigram, 2 BPE."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(sp.serialized_model_proto())
    return proto.trainer_spec.model_type


class Search:
    """The streaming search: push characters, take committed ids, finish."""

    def __init__(self, model: Model):
        self.model = model
        self.text = ""  # not committed yet
        self.last: list[str | None] = [None]  # the last piece of the path to each position
        self.best: list[float] = [0.0]
        self.whole = True  # nothing was committed: the window begins where the text does

    def start(self, text: str) -> int:
        """Begin with another text. What it has in common with the last one is not searched
        again; returns where to push on from."""
        n, k = min(len(self.text), len(text)) if self.whole else 0, 0
        while k < n and self.text[k] == text[k]:
            k += 1
        self.text, self.whole = text[:k], True
        del self.last[k + 1 :], self.best[k + 1 :]
        self.last[0], self.best[0] = None, 0.0
        return k

    def advance(self) -> None:
        m, text, last, best = self.model, self.text, self.last, self.best
        reachable, longest_to = m.reachable, m.longest_to
        if not m.bpe:
            for j in range(len(last), len(text) + 1):
                found, top = None, -np.inf
                for i in range(max(0, j - longest_to.get(text[j - 2 : j], 1)) if j > 1 else 0, j):
                    p = text[i:j]
                    if j - i > 1 and p not in reachable or i and last[i] is None:
                        continue
                    s = best[i] + m.score.get(p, m.least)
                    if s > top:
                        found, top = p, s
                last.append(found)
                best.append(top)
            return
        pairs, longest_of = m.pairs, m.longest_of
        for j in range(len(last), len(text) + 1):
            found = None
            i = j - longest_of.get(text[j - 3 : j], 2) if j > 2 else 0
            if i < 0:
                i = 0
            while i < j:
                p = text[i:j]
                if j - i == 1 or p in reachable:
                    if i == 0:
                        found = p
                        break
                    before = last[i]
                    if before is not None:
                        after = pairs.get(before)
                        ok = None if after is None else after.get(p)
                        if ok is None:
                            ok = m.fits(before, p)
                            pairs = m.pairs
                        if ok:
                            found = p
                            break
                i += 1
            last.append(found)
            best.append(0.0)

    def _path(self, end: int) -> list[str]:
        out = []
        while end:
            out.append(self.last[end])
            end -= len(self.last[end])
        return out[::-1]

    def push_pieces(self, chars: str) -> list[str]:
        """Take in characters; return the pieces that became final."""
        self.text += chars
        self.advance()
        n = len(self.text)
        if n <= STEP:
            return []
        # Later pieces start at one of the window's positions; follow all paths from there.
        ends = {j for j in range(max(0, n - self.model.longest + 1), n + 1) if j == 0 or self.last[j] is not None}
        while len(ends) > 1:
            j = max(ends)
            ends.remove(j)
            ends.add(j - len(self.last[j]))
        at = ends.pop()
        if at <= 0:
            return []
        # The piece before the boundary stays: it decides which pieces may follow.
        path = self._path(at)
        kept = path[-1]
        cut = at - len(kept)
        if cut <= 0:
            return []
        self.text, self.last, self.best = self.text[cut:], [None, *self.last[cut + 1 :]], self.best[cut:]
        for k in range(1, len(kept)):
            self.last[k] = None  # positions inside the piece are on no surviving path
        self.whole = False
        return path[:-1]

    def finish_pieces(self) -> list[str]:
        """The pieces of what is left. The search is to be started again."""
        return self._path(len(self.text))

    def push(self, chars: str) -> list[int]:
        """The ids that became final."""
        return [i for p in self.push_pieces(chars) for i in self.model.ids_of(p)]

    def finish(self) -> list[int]:
        ids = [i for p in self.finish_pieces() for i in self.model.ids_of(p)]
        self.text, self.last, self.best, self.whole = "", [None], [0.0], True
        return ids


@functools.lru_cache(maxsize=2)
def load(path: str) -> Model:
    """The model, and the pairs it remembers, until the worker turns to another operator."""
    return Model(path)


@tidy
def _encode(batches, model_path: str):
    turn_to("sentencepiece_codec", load.cache_clear)
    model = load(model_path)
    for batch in batches:
        data, offsets = strings(batch.column(1))
        for a, b in slices(offsets, SLICE):
            texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(a, b)]
            raw = model.encode_batch(texts)
            sizes = np.array([len(x) // 4 for x in raw], np.int32)
            values = np.frombuffer(b"".join(raw), "<i4")
            same = [model.decode(np.frombuffer(x, "<i4").tolist()) == t for x, t in zip(raw, texts)]
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes.astype(np.int64)), ids, pa.array(same)], ["id", "n_tokens", "ids", "round_trip"])
    model.parts, model.segments = {}, {}  # a worker that waits holds the model and its pairs only


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_tokens, ids and whether decoding them gives the text.

    Null and empty texts have no ids. The one text that doesn't come back as it was is one
    with U+2581, which the model takes for a space. Repeated rows, null ids and whatever other
    columns there are change nothing; an empty table gives an empty result.
    """
    session.ship_code(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(lambda it: _encode(it, model_path), "id long, n_tokens long, ids array<int>, round_trip boolean").withColumnRenamed("id", id_col)


@tidy
def _decode(batches, model_path: str):
    model = load(model_path)
    for batch in batches:
        texts = [None if x is None else model.decode(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])


def decode(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of each row's ids; null ids give null."""
    session.ship_code(tokens.sparkSession)
    return tokens.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(lambda it: _decode(it, model_path), "id long, text string").withColumnRenamed("id", id_col)
