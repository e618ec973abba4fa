"""Exact encoding and decoding for merge-type SentencePiece models.

A sequence of pieces is what merging gives exactly when each piece merges to
itself and every two neighbours, merged again from their characters, come back
as the same two pieces.  So a text can be encoded without a merge queue: at
each position take the longest piece that an Aho-Corasick automaton finds and
that is compatible with the piece before it, else a shorter one, else go back.
A bitfield remembers positions from which no encoding goes on, so each is given
up once.

Texts are first covered by longest matches, and all neighbours are checked
against a table of known pairs.  Where the character pair at a border is in no
piece, no merge ever crosses it; so a stretch between two such borders with an
incompatible pair in it is searched again by itself, with backtracking.

Decoding joins the texts of the ids: a table of pieces is taken by id.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from math import inf
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import blocks, map_arrow, only, read, worker_table

#: Bytes of the searched stretches that a worker keeps, and entries of its other tables.
TABLE_BYTES, TABLE_ENTRIES = 8 << 20, 200_000
#: Characters of text that are encoded at a time.
BLOCK_CHARS = 1 << 20
SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_SLOTS = 20
#: States of a pair of neighbours: no piece holds the two characters at the border; compatible; not compatible.
_APART, _FIT, _UNFIT = 0, 1, 2


def load_model(path: str) -> dict:
    """The parts of a model file that encoding needs: pieces, scores, kinds."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    normal = proto.normalizer_spec
    kinds = {p.type for p in proto.pieces}
    if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
        raise ValueError("only merge-type models with byte fallback and plain pieces are supported")
    if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix or not normal.escape_whitespaces:
        raise ValueError("only models that keep the text and mark its start with a space are supported")
    model = {"pieces": [p.piece for p in proto.pieces], "scores": [p.score for p in proto.pieces], "kinds": [p.type for p in proto.pieces]}
    plain = [p for p, k in zip(model["pieces"], model["kinds"], strict=True) if k == _NORMAL]
    if any(SPACE in p.lstrip(SPACE) for p in plain):
        raise ValueError("pieces with a space after other characters are not supported")
    return model


class Encoder:
    """Encodes and decodes texts with one model; one per Python worker."""

    def __init__(self, model: dict, entries: int = TABLE_ENTRIES, kept_bytes: int = TABLE_BYTES, slots: int = _SLOTS) -> None:
        import ahocorasick

        kinds = model["kinds"]
        self.entries, self.kept_bytes = entries, kept_bytes
        self.model = model
        self.ids = {p: i for i, (p, k) in enumerate(zip(model["pieces"], kinds, strict=True)) if k == _NORMAL}
        self.score = {p: model["scores"][i] for p, i in self.ids.items()}
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(model["pieces"], kinds, strict=True)) if k == _BYTE}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.end_id = model["pieces"].index("</s>")
        self.whole: dict[str, bool] = {}
        self.halves: dict[str, tuple[str, str]] = {}  # the last merge of each whole piece
        self.edges: dict[tuple[str, bool], list[str]] = {}
        self.fits: dict[int, bool] = {}
        alphabet = {p for p in self.ids if len(p) == 1}
        if not {c for p in self.ids for c in p} <= alphabet:
            raise ValueError("only models whose pieces consist of characters that are pieces are supported")
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.whole_pieces = ahocorasick.Automaton()
        for piece in filter(self._is_whole, self.ids):
            self.whole_pieces.add_word(piece, self.ids[piece])
        alone = {chr(b) for b in range(128)} - alphabet  # one byte, one id
        for c in alone:
            self.whole_pieces.add_word(c, self.byte_ids[ord(c)])
        self.whole_pieces.make_automaton()
        known = sorted(alphabet | alone | {" "})  # a space becomes SPACE
        self.odd = re.compile("([^" + "".join(map(re.escape, known)) + "])")
        # by id: characters, first and last character; the bytes that a text has for it, the decimal id
        size = len(model["pieces"])
        self.piece_of = [p if k == _NORMAL else "" for p, k in zip(model["pieces"], kinds, strict=True)]
        self.length_of = list(map(len, self.piece_of))
        self.shorter = [next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if self.whole.get(p[:k])), -1) for p in self.piece_of]  # the longest piece that starts it
        self.raw_of = pa.array([self._raw(i) for i in range(size)], pa.binary())
        self.digits_of = pa.array([str(i) for i in range(size)], pa.string())
        self.slots, self.shift = 1 << slots, np.uint64(64 - slots)
        self.pair_at, self.state_at = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int8)
        self.again: dict[bytes, bytes] = {}  # ids of stretches with an incompatible pair -> their ids by search
        self.again_bytes = 0

    def _raw(self, i: int) -> bytes:
        kind = self.model["kinds"][i]
        return self.model["pieces"][i].replace(SPACE, " ").encode() if kind == _NORMAL else bytes([self.bytes_of[i]]) if kind == _BYTE else " ⁇ ".encode() if kind == _UNKNOWN else b""

    def merge(self, text: str, until: int = 1) -> list[str]:
        """Merge characters as the model's scores say: best score first, then leftmost."""
        parts, score = list(text), self.score
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _is_whole(self, piece: str) -> bool:
        """Whether the piece's characters merge to the piece, from halves that score no less."""
        found = self.whole.get(piece)
        if found is None:
            found = len(piece) == 1
            if not found:
                halves = self.merge(piece, until=2)
                found = len(halves) == 2 and self.score.get(piece) is not None
                if found:
                    self.halves[piece] = (halves[0], halves[1])
                    if any(len(h) > 1 and self.score[h] < self.score[piece] for h in halves):
                        raise ValueError(f"{piece!r} scores above its halves: not a merge-type model")
                    found = all(map(self._is_whole, halves))
            self.whole[piece] = found
        return found

    def _edge(self, piece: str, last: bool) -> list[str]:
        """What stands at the piece's first or last end while it is merged, the character first."""
        found = self.edges.get((piece, last))
        if found is None:
            before = self._edge(self.halves[piece][last], last) if len(piece) > 1 and self._is_whole(piece) else []
            found = self.edges[piece, last] = [*before, piece]
        return found

    def _compatible(self, left: str, right: str) -> bool:
        """Merging both again gives both: no merge over their border comes first.

        Halves never score below their piece, so all that matters is what
        stands at the border; of equal scores the leftmost merge comes first.
        """
        a, b, score = self._edge(left, True), self._edge(right, False), self.score
        i = j = 0
        while True:
            over = score.get(a[i] + b[j], -inf)
            more = score[a[i + 1]] if i + 1 < len(a) else -inf
            next_ = score[b[j + 1]] if j + 1 < len(b) else -inf
            if over > more and over >= next_:
                return False
            if more == next_ == -inf:
                return over == -inf
            if more >= next_:
                i += 1
            else:
                j += 1

    def _search(self, text: str) -> list[int]:
        """Ids of a text whose characters are all pieces themselves."""
        n, size, fits, shorter, length = len(text), len(self.piece_of), self.fits, self.shorter, self.length_of
        longest = self.whole_pieces.iter_long
        chosen: list[int] = []
        failed, at, before, piece = bytearray(n + 1), 0, -1, next(longest(text))[1]
        while True:
            while piece >= 0:
                if not failed[at + length[piece]]:
                    if before < 0:
                        break
                    fit = fits.get(before * size + piece)
                    if fit is None:
                        fit = fits[before * size + piece] = self._compatible(self.piece_of[before], self.piece_of[piece])
                    if fit:
                        break
                piece = shorter[piece]
            if piece >= 0:
                chosen.append(piece)
                at += length[piece]
                if at == n:
                    return chosen
                before, piece = piece, next(longest(text, at))[1]
            else:
                failed[at] = 1
                piece = chosen.pop()
                at -= length[piece]
                before, piece = chosen[-1] if chosen else -1, shorter[piece]

    def _longest(self, text: str) -> np.ndarray:
        """Ids of the longest matches that cover a text, the bytes of characters that are no pieces included."""
        marked = SPACE + text.replace(" ", SPACE)
        if not self.odd.search(text):
            return np.fromiter(map(itemgetter(1), self.whole_pieces.iter_long(marked)), np.int32)
        out: list[int] = []
        for k, part in enumerate(self.odd.split(marked)):
            out += [self.byte_ids[b] for b in part.encode()] if k % 2 else map(itemgetter(1), self.whole_pieces.iter_long(part))
        return np.array(out, np.int32)

    def _state(self, left: int, right: int) -> int:
        a, b = self.piece_of[left], self.piece_of[right]
        if not a or not b or a[-1] + b[0] not in self.pairs:
            return _APART
        return _FIT if self._compatible(a, b) else _UNFIT

    def _states(self, ids: np.ndarray) -> np.ndarray:
        """The state of every two neighbours; pairs met before come from a table of fixed size."""
        size = len(self.piece_of)
        codes = ids[:-1].astype(np.int64) * size + ids[1:]
        slot = (codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
        states = self.state_at[slot]
        missing = np.flatnonzero(self.pair_at[slot] != codes)
        if len(missing):
            fresh, where = np.unique(codes[missing], return_inverse=True)
            found = np.fromiter((self._state(c // size, c % size) for c in fresh.tolist()), np.int8, len(fresh))
            states[missing] = found[where]
            place = (fresh.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
            self.state_at[place], self.pair_at[place] = found, fresh  # of two in one slot the last stays, in both
        return states

    def _searched(self, stretch: bytes) -> bytes:
        """The ids of a stretch between borders that no piece crosses, searched with backtracking."""
        found = self.again.get(stretch)
        if found is None:
            found = array("i", self._search("".join([self.piece_of[i] for i in array("i", stretch)]))).tobytes()
            if len(stretch) < 512:
                self.again[stretch] = found
                self.again_bytes += len(stretch) + len(found) + 200
        return found

    def encode_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each text's number of ids); the end id is each text's last."""
        each = [np.append(self._longest(t) if t else np.zeros(0, np.int32), np.int32(self.end_id)) for t in texts]
        counts = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.concatenate(each) if each else np.zeros(0, np.int32)
        if not len(flat):
            return flat, counts
        states = self._states(flat)  # an end id stands apart, so no stretch runs over two texts
        unfit = np.flatnonzero(states == _UNFIT)
        if not len(unfit):
            return flat, counts
        starts = np.concatenate(([0], np.flatnonzero(states == _APART) + 1, [len(flat)]))
        which = np.unique(np.searchsorted(starts, unfit, side="right")) - 1
        first, past = starts[which], starts[which + 1]
        raw = flat.tobytes()
        new = [self._searched(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), past.tolist(), strict=True)]
        kept = [raw[4 * a : 4 * b] for a, b in zip([0, *past.tolist()], [*first.tolist(), len(flat)], strict=True)]
        out = [b""] * (len(new) + len(kept))
        out[::2], out[1::2] = kept, new
        text = np.searchsorted(np.cumsum(counts), first, side="right")
        np.add.at(counts, text, np.fromiter(map(len, new), np.int64, len(new)) // 4 - (past - first))
        if self.again_bytes > self.kept_bytes:
            self.again, self.again_bytes = {}, 0
        if len(self.fits) > self.entries:
            self.fits = {}
        return np.frombuffer(b"".join(out), np.int32), counts

    def encode_block(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """For each text: decimal ids joined by spaces, their number, the decoded text."""
        flat, counts = self.encode_ids(texts)
        return list(zip(self.spoken(flat, counts).to_pylist(), counts.tolist(), self.decode_ids(flat, counts).to_pylist(), strict=True))

    def encode(self, text: str) -> list[int]:
        """All ids of a text, the end id last."""
        return self.encode_ids([text])[0].tolist()

    def decode_ids(self, flat: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of ids that stand one after the other: each id's bytes from the table, joined; the start mark goes."""
        joined = pc.binary_join(_lists(flat, counts, self.raw_of), b"").to_pylist()
        return pa.array([decode_bytes(t).removeprefix(" ") for t in joined], pa.string())

    def decode(self, ids) -> str:
        """The text of ids; the start mark goes."""
        return self.decode_ids(np.array(ids, np.int32), np.array([len(ids)]))[0].as_py()

    def spoken(self, flat: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The ids in decimal, joined by spaces."""
        return pc.binary_join(_lists(flat, counts, self.digits_of), " ")


def _lists(flat: np.ndarray, counts: np.ndarray, table: pa.Array) -> pa.Array:
    """For each text the table's entries of its ids."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), table.take(pa.array(flat)))


def decode_bytes(raw: bytes) -> str:
    """Byte pieces in a row: UTF-8, one replacement character for each byte that fits none."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def encode_texts(docs: DataFrame, model: dict, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids, decoded): ids in decimal, joined by spaces, the end id last.

    One output row per input row, in the task that reads it.  A null or empty
    text has the end id alone and decodes to an empty text.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a model file: under 1 MB whatever the corpus
    name = hashlib.sha256(repr(sorted(model.items())).encode()).hexdigest()

    def run(batches):
        encoder = worker_table(name, lambda: Encoder(shipped.value))
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for block in blocks(rows, lambda r: len(r[1] or ""), BLOCK_CHARS):
                flat, counts = encoder.encode_ids([t or "" for _, t in block])
                columns = [pa.array([k for k, _ in block], type=batch.schema.field(0).type), pa.array(counts), encoder.spoken(flat, counts), encoder.decode_ids(flat, counts)]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(only(docs, key, text), run, f"`{key}` {kind}, n_tokens long, ids string, decoded string")


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of encode_texts()."""
    return encoded.select(key, "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with piece_bpe_32k.model and decoded again."""
    import public_tokenizers

    return digests(encode_texts(read(spark, sf_dir, "documents"), load_model(public_tokenizers.path("piece_bpe_32k.model"))))
