"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At each position the automaton yields every piece that ends there (its output links), and each relaxes the best score of
the position with the one of where it begins. Characters that no piece covers fall back to their bytes' pieces.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm import text as T

SPACE = "▁"
#: Below the lowest piece's score by this much is a character without a piece.
UNKNOWN_PENALTY = 10.0
#: Cached segments; at this many the cache starts anew. About 200 MB a worker.
CACHE = 500_000
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]*")


class Pieces:
    """A vocabulary's pieces with scores, and the automaton over them."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: dict[int, int], unknown: int, cache: int = CACHE):
        """pieces: (text, score, id) of ordinary ones; byte_ids: ids of byte pieces, all 256 or none."""
        import ahocorasick

        self.text = {i: p for p, _, i in pieces}
        self.bytes_of = {i: b for b, i in byte_ids.items()}
        self.byte_ids = byte_ids if len(byte_ids) == 256 else {}
        self.unknown = unknown
        self.single = {p for p, _, _ in pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, score, i in pieces:
            self.automaton.add_word(p, (len(p), score, i))
        self.automaton.make_automaton()
        self.lost = min((s for _, s, _ in pieces), default=0.0) - UNKNOWN_PENALTY
        # a cut before a space mark loses nothing unless a piece goes on over one
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p, _, _ in pieces)
        self.cache: dict[str, tuple[bytes, float, int]] = {}
        self.limit = cache

    @staticmethod
    @lru_cache(2)
    def load(path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary, byte_ids = [], {}
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ordinary.append((sp.id_to_piece(i), sp.get_score(i), i))
        return Pieces(ordinary, byte_ids, sp.unk_id())

    def viterbi(self, s: str) -> tuple[list[int], float]:
        """Ids of the best segmentation of s and its score; ties go to the longer last piece."""
        n = len(s)
        best = [0.0] + [None] * n
        back: list = [None] * (n + 1)
        done = 0  # positions up to here have their best score

        def settle(upto: int) -> None:
            nonlocal done
            while done < upto:
                done += 1
                if s[done - 1] not in self.single:
                    total = best[done - 1] + self.lost
                    if best[done] is None or total > best[done]:
                        best[done] = total
                        back[done] = (done - 1, -1)

        for end, (size, score, i) in self.automaton.iter(s):
            start = end + 1 - size
            if done < end:
                settle(end)  # all pieces that end before this one have been seen
            total = best[start] + score
            if best[end + 1] is None or total > best[end + 1] or (total == best[end + 1] and start < back[end + 1][0]):
                best[end + 1] = total
                back[end + 1] = (start, i)
        settle(n)
        ids: list[int] = []
        at = n
        while at:
            start, i = back[at]
            if i >= 0:
                ids.append(i)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in reversed(s[start:at].encode())]
            else:
                ids.append(self.unknown)
            at = start
        return ids[::-1], best[n]

    def _segment(self, s: str) -> tuple[bytes, float, int]:
        found = self.cache.get(s)
        if found is None:
            ids, score = self.viterbi(s)
            found = (np.array(ids, "<u4").tobytes(), score, len(ids))
            if len(self.cache) >= self.limit:
                self.cache.clear()
            self.cache[s] = found
        return found

    def encode(self, text: str) -> tuple[np.ndarray, float]:
        """Ids of a whole text and their score. Blanks become space marks, one more stands in front; empty gives none."""
        if not text:
            return np.zeros(0, "<u4"), 0.0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.cuts:
            ids, score = self.viterbi(marked)
            return np.array(ids, "<u4"), score
        if SPACE + SPACE in marked:
            segments = [x for x in _SEGMENT.findall(marked) if x]
        else:
            segments = [SPACE + x for x in marked[1:].split(SPACE)]
        found = [self._segment(x) for x in segments]
        return np.frombuffer(b"".join([f[0] for f in found]), "<u4"), sum([f[1] for f in found])

    def decoded(self) -> list[bytes]:
        """The bytes that each id stands for, space marks as blanks."""
        out = ["�".encode()] * (max([self.unknown, *self.text, *self.bytes_of]) + 1)
        for i, p in self.text.items():
            out[i] = p.encode("utf-8", "surrogatepass").replace(SPACE.encode(), b" ")
        for i, b in self.bytes_of.items():
            out[i] = bytes([b])
        return out

    def decode(self, ids) -> str:
        """The text of ids: byte pieces joined as UTF-8, space marks as blanks, the one in front gone."""
        out = bytearray()
        for i in ids:
            i = int(i)
            out += bytes([self.bytes_of[i]]) if i in self.bytes_of else self.text.get(i, "�").encode("utf-8", "surrogatepass")
        return out.decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ")


def encode(docs: DataFrame, *, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, ids, n_pieces, score, ids_crc32, decoded_sha256, round_trip, one row per input row.

    decoded_sha256 is that of the text decoded from the ids, as UTF-8; round_trip tells whether it is the input. Null text
    is encoded as empty: no ids, score 0. A text with the space mark itself decodes to a blank there. Repeated rows and null
    ids are rows like any others. An empty table gives an empty result. with_ids=False leaves the ids out.
    """
    common.ship(docs.sparkSession)
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, " + "ids array<int>, " * with_ids + "n_pieces long, score double, ids_crc32 long, decoded_sha256 string, round_trip boolean"

    def run(batches):
        pieces = Pieces.load(vocabulary)
        table = pieces.decoded()
        for b in batches:
            texts = T.texts_of(b)
            for lo, hi in T.chunks(texts, 1 << 20):
                rows = []
                for t in texts[lo:hi]:
                    raw = t or b""
                    ids, score = pieces.encode(raw.decode("utf-8", "replace"))
                    back = b"".join(map(table.__getitem__, ids.tolist()))[1:]
                    rows.append((ids, len(ids), score, zlib.crc32(ids.tobytes()), hashlib.sha256(back).hexdigest(), back == raw))
                ids, n, score, crc, sha, same = zip(*rows, strict=True)
                out = [b.column(0).slice(lo, hi - lo)]
                if with_ids:
                    size = np.concatenate([[0], np.cumsum(n)])
                    out.append(pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate(ids).astype("<i4"), pa.int32())))
                out += [pa.array(n, pa.int64()), pa.array(score, pa.float64()), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same)]
                yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in schema.split(", ")])

    return named.mapInArrow(run, schema)


def decode(encoded: DataFrame, *, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids; null ids give a null text."""
    common.ship(encoded.sparkSession)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        pieces = Pieces.load(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else pieces.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
