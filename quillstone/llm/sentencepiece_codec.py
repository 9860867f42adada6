"""SentencePiece encoding and decoding over a trie of distinct marked words.

Distinct marked words (runs of the space mark and what follows) are sorted, which lays them out as a
trie in depth-first order: a word keeps the forward states of the prefix it shares with the word
before and computes only what is new.

A unigram model's state is the best score of the prefix with its last piece (Viterbi). A BPE model
ranks merges instead, and the sum of its scores isn't what the library maximises; there a prefix has
exactly one encoding that merging can give, and it is the one whose every two neighbours would be
left apart by merging. So the state is the last piece of that encoding, found among the pieces that
end at the place, longest first, by that test against the state before it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterable

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, slices, texts_of
from .token_counts import tokenizer_path

MARK = "▁"
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Distinct words whose ids a worker remembers at most.
KNOWN_WORDS = 1_000_000
#: What one character without a piece costs a unigram path, below the least score.
_UNKNOWN = 10.0


class Codec:
    """Pieces of a model with byte fallback, and the ids of whole texts."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], spelled: list[bytes], kind: str = "bpe"):
        self.pieces, self.byte_ids, self.spelled, self.kind = pieces, byte_ids, spelled, kind
        #: What pieces end with: the piece's id where it is one, else -1. Longer endings needn't be tried
        #: where a shorter one isn't here.
        self.tails: dict[str, int] = {}
        for p, (number, _) in pieces.items():
            for k in range(1, len(p)):
                self.tails.setdefault(p[k:], -1)
            self.tails[p] = number
        self.least = min((s for _, s in pieces.values()), default=0.0) - _UNKNOWN
        #: By two pieces' ids, and by one's.
        self.left_apart: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        # a piece with a mark after another character would cross words; such a model is read as one word a text
        self.crossing = any(MARK in p.lstrip(MARK) for p in pieces)

    @classmethod
    def load(cls, name: str, kind: str = "bpe") -> Codec:
        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        text = [sp.id_to_piece(i) for i in range(n)]
        spelled = [b"" if special[i] else bytes([int(text[i][3:5], 16)]) if sp.is_byte(i) else text[i].replace(MARK, " ").encode() for i in range(n)]
        return cls({text[i]: (i, sp.get_score(i)) for i in range(n) if not special[i] and not sp.is_byte(i)}, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], spelled, kind)

    def merges(self, text: str) -> list[str]:
        """What merging makes of a text, best piece first and leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.pieces[p][1], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.pieces), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _stand_alone(self, number: int, piece: str) -> bool:
        self.alone[number] = fit = self.merges(piece) == [piece]
        return fit

    def _apart(self, key: tuple[int, int], a: str, b: str) -> bool:
        if len(self.left_apart) > 2 * KNOWN_WORDS:
            self.left_apart.clear()
        self.left_apart[key] = fit = self.merges(a + b) == [a, b]
        return fit

    def _state(self, word: str, i: int, states: list) -> tuple:
        """(start of the last piece, score, the piece's id or -1) of the prefix of i characters."""
        ending, tails, start = [], self.tails, i - 1
        while start >= 0:
            number = tails.get(word[start:i])
            if number is None:
                break
            if number >= 0:
                ending.append((start, number))
            start -= 1
        best = None
        for start, number in reversed(ending):
            before, score, last = states[start]
            if self.kind == "unigram":
                score += self.pieces[word[start:i]][1]
                if best is None or score > best[1]:
                    best = (start, score, number)
                continue
            # what was asked before is remembered, for most places that is all there is to do
            fit = self.alone.get(number)
            if fit is None:
                fit = self._stand_alone(number, word[start:i])
            if fit and last >= 0:
                fit = self.left_apart.get((last, number))
                if fit is None:
                    fit = self._apart((last, number), word[before:start], word[start:i])
            if fit:
                return start, 0.0, number
        if word[i - 1] not in self.pieces:
            lone = (i - 1, states[i - 1][1] + self.least, -1)
            best = lone if best is None or lone[1] > best[1] else best
        return best

    def learn(self, words: Iterable[str]) -> None:
        """Encode distinct words, in sorted order, sharing the states of common prefixes."""
        before, states = "", [(0, 0.0, -1)]
        for word in sorted(words):
            same = 0
            while same < min(len(before), len(word)) and before[same] == word[same]:
                same += 1
            del states[same + 1 :]
            for i in range(same + 1, len(word) + 1):
                states.append(self._state(word, i, states))
            before, ids, i = word, [], len(word)
            while i:
                start, _, number = states[i]
                if number >= 0:
                    ids.append(number)
                else:
                    ids += [self.byte_ids[b] for b in word[start:i].encode()][::-1]
                i = start
            self.known[word] = array("i", ids[::-1]).tobytes()

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        units = [[m] if self.crossing and m else _UNIT.findall(m) for m in marked]
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        self.learn({u for us in units for u in us}.difference(self.known))
        return [b"".join(map(self.known.__getitem__, us)) for us in units]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [array("i", x).tolist() for x in self.packed(texts)]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.spelled.__getitem__, ids)).decode(errors="replace").removeprefix(" ")


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(name: str, kind: str) -> Codec:
    if (name, kind) not in _CODECS:
        _CODECS[name, kind] = Codec.load(name, kind)
    return _CODECS[name, kind]


def encode_pieces(docs: DataFrame, name: str = "piece_bpe_32k.model", kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): the ids of each whole text, without begin and end. Null and empty texts have
    none; texts are read whole, however long. Repeated and null ids of rows are kept as they are. Other
    columns aren't read, whatever their names; an empty table gives no rows."""

    def run(batches):
        c = codec(name, kind)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for lo, hi in slices(texts):
                got = c.encode([t.decode(errors="replace") for t in texts[lo:hi]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(got, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` long, ids array<int>")


def decode_pieces(coded: DataFrame, name: str = "piece_bpe_32k.model", kind: str = "bpe", ids_col: str = "ids") -> DataFrame:
    """All columns of coded, and decoded: the text that ids spell; null ids give null, no ids an empty text.
    A column of coded named decoded gives way; repeated rows are decoded alike, and an empty table stays
    empty."""

    @F.arrow_udf("string")
    def spell(ids: pa.Array) -> pa.Array:
        c = codec(name, kind)
        return pa.array([None if x is None else c.decode(x) for x in ids.to_pylist()], pa.string())

    return coded.select(*(c for c in coded.columns if c != "decoded"), spell(F.col(ids_col)).alias("decoded"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of ids and text, and whether the text came back."""

    def digest(batches):
        c = codec("piece_bpe_32k.model", "bpe")
        for batch in batches:
            texts = texts_of(batch.column(1))
            for lo, hi in slices(texts):
                got = c.packed([t.decode(errors="replace") for t in texts[lo:hi]])
                back = [c.decode(array("i", x)).encode() for x in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array([len(x) // 4 for x in got], pa.int64()), pa.array([zlib.crc32(x) for x in got], pa.int64()),
                        pa.array([hashlib.sha256(b).hexdigest() for b in back]), pa.array([b == t for b, t in zip(back, texts[lo:hi], strict=True)]),
                    ],
                    names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip"],
                )

    return documents(spark, sf_dir).select("doc_id", "text").mapInArrow(digest, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
