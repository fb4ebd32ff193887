"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The text, with a space before it and every space turned into the mark U+2581, is cut into segments that no piece of the
vocabulary can span: a run of marks with the characters after it, or a line feed.  Segments not in the worker's cache
are encoded together: one flat symbol array, the smallest pair rank of each segment by a segmented minimum, that pair
merged at its leftmost places in all segments at once, then compaction, until no pair is left.  Characters outside the
vocabulary become byte pieces.

Two places of the same pair are merged in one round only where that equals merging the leftmost first: always when no
pair with the merged piece ranks before the piece itself, else when more than twice the longest piece lies between.

Cases: a null or empty text has no ids and decodes to an empty text; a null id, repeated ids and rows each give their
own row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nearfold.llm.texts import IntTable, Recent, map_texts, sha

MARK = "▁"
#: Segments in a worker's cache at most; longer ones than SEGMENT_CHARS are not kept.
CACHE_SEGMENTS, SEGMENT_CHARS = 240_000, 64
_SEGMENT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_NONE = np.int32(2**31 - 1)


class PieceCodec:
    """Encoder and decoder for a SentencePiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.size = size
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i)}
        self.unknown = sp.unk_id()
        bytes_ = [i for i in range(size) if sp.is_byte(i)]
        self.byte_of = {i: int(self.pieces[i][1:-1], 16) for i in bytes_}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        plain = {p: i for i, p in enumerate(self.pieces) if i not in self.special and i not in self.byte_of}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in plain):
            raise ValueError("a piece spans a word or line border; segments would not be independent")
        order = sorted((i for p, i in plain.items() if len(p) > 1), key=lambda i: (-sp.get_score(i), i))
        rank = np.full(size, _NONE, dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        keys, made = [], []
        for p, i in plain.items():
            for k in range(1, len(p)):
                a, b = plain.get(p[:k]), plain.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * size + b)
                    made.append(i)
        self.pairs = IntTable(np.array(keys, dtype=np.int64), np.array(made, dtype=np.int32))
        self.rank = rank
        self.by_rank = np.array(order or [0], dtype=np.int32)
        first = rank.copy()  # the best rank of any pair that has the piece as a part
        for key, i in zip(keys, made, strict=True):
            for part in divmod(key, size):
                if part < len(first) and rank[part] != _NONE:
                    first[part] = min(first[part], rank[i])
        self.safe = first >= rank
        self.longest = max(map(len, plain), default=1)
        chars = np.arange(size, size + 0x110000, dtype=np.int32)  # a character outside the vocabulary: size + its code
        for p, i in plain.items():
            if len(p) == 1:
                chars[ord(p)] = i
        self.chars = chars
        self.number = np.array([str(i) for i in range(size)], dtype=object)
        self.spelled = np.array([p.replace(MARK, " ") for p in self.pieces], dtype=object)
        self.encoded = Recent(CACHE_SEGMENTS)
        self.decoded: dict[str, str] = {}

    def merge(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all the (non-empty) segments, and where each segment ends; size + c: a character c to be spelled in bytes."""
        sym = self.chars[np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        word = np.repeat(np.arange(len(segments), dtype=np.int32), [len(s) for s in segments])
        done_sym, done_word = [], []
        gap = 2 * self.longest
        r = np.full(len(sym), _NONE, dtype=np.int32)  # rank of what each symbol and the next one make
        self._look(sym, word, r, np.arange(len(sym) - 1))
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(r, starts)
            spread = np.repeat(best, np.diff(np.r_[starts, len(sym)]))
            over = spread == _NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                live = ~over
                sym, word, r, spread = sym[live], word[live], r[live], spread[live]
                if not len(sym):
                    break
            place = np.flatnonzero(r == spread)
            piece = self.by_rank[spread[place]]
            if len(place) > 1:
                step, new = np.diff(place), word[place[1:]] != word[place[:-1]]
                run = np.r_[True, (step > 1) | new]  # overlapping places: every second one of a run
                nth = np.arange(len(place)) - np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
                apart = np.r_[True, (step > gap) | new]
                take = np.where(self.safe[piece], nth % 2 == 0, apart)
                place, piece = place[take], piece[take]
            sym[place] = piece
            stay = np.ones(len(sym), dtype=bool)
            stay[place + 1] = False
            sym, word, r = sym[stay], word[stay], r[stay]
            place -= np.arange(len(place))  # so many symbols before each have gone
            self._look(sym, word, r, np.concatenate([place, place[place > 0] - 1]))
        out_word = np.concatenate(done_word) if done_word else np.zeros(0, dtype=np.int64)
        out_sym = np.concatenate(done_sym) if done_sym else np.zeros(0, dtype=np.int32)
        by = np.argsort(out_word, kind="stable")
        ends = np.cumsum(np.bincount(out_word, minlength=len(segments)))
        return out_sym[by], ends

    def _look(self, sym: np.ndarray, word: np.ndarray, r: np.ndarray, at: np.ndarray) -> None:
        """Set r[at]."""
        r[at] = _NONE
        at = at[at + 1 < len(sym)]
        both = (word[at + 1] == word[at]) & (sym[at] < self.size) & (sym[at + 1] < self.size)
        at = at[both]
        made = self.pairs.get(sym[at].astype(np.int64) * self.size + sym[at + 1])
        found = made >= 0
        r[at[found]] = self.rank[made[found]]

    def _fallback(self, code: int) -> list[int]:
        if not self.byte_id:
            return [self.unknown]
        return [self.byte_id[b] for b in chr(code).encode("utf-8", "surrogatepass")]

    def text_of(self, ids: list[int]) -> str:
        """The text of ids, the leading space included."""
        out, held = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(held):  # what is no character becomes U+FFFD, byte by byte
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(held[at : at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            held.clear()

        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            flush()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.special:
                out.append(self.pieces[i].replace(MARK, " "))
        flush()
        return "".join(out)

    def segments(self, text: str) -> list[str]:
        return _SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, new: list[str]) -> None:
        """Encode and decode the segments into the cache."""
        flat, ends = self.merge(new)
        odd = np.add.reduceat(flat >= self.size, np.r_[0, ends[:-1]]).tolist()
        ids, texts = self.number[flat * (flat < self.size)].tolist(), self.spelled[flat * (flat < self.size)].tolist()
        a = 0
        for s, b, other in zip(new, ends.tolist(), odd, strict=True):
            if other:
                own = [j for i in flat[a:b].tolist() for j in ([i] if i < self.size else self._fallback(i - self.size))]
                self.encoded[s], self.decoded[s] = ",".join(map(str, own)), self.text_of(own)
            else:
                self.encoded[s], self.decoded[s] = ",".join(ids[a:b]), "".join(texts[a:b])
            a = b

    def digest(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """For each text: the number of ids, the ids joined by commas, the decoded text."""
        split = [self.segments(t) for t in texts]
        new = self.encoded.missing(set().union(*split))
        if new:
            self.learn(new)
        if len(self.decoded) > 2 * CACHE_SEGMENTS:
            self.decoded = {s: d for s, d in self.decoded.items() if s in self.encoded or s in self.encoded.old}
        ids = [",".join(map(self.encoded.__getitem__, parts)) for parts in split]
        back = ["".join(map(self.decoded.__getitem__, parts)).removeprefix(" ") for parts in split]
        for s in new:
            if len(s) > SEGMENT_CHARS:
                del self.encoded[s], self.decoded[s]
        return [x.count(",") + 1 if x else 0 for x in ids], ids, back

    def encode(self, text: str) -> list[int]:
        joined = self.digest([text])[1][0]
        return [int(x) for x in joined.split(",")] if joined else []

    def decode(self, ids: list[int]) -> str:
        first = next((i for i in ids if i not in self.special or i == self.unknown), self.unknown)
        text = self.text_of(ids)
        return text[1:] if first not in self.byte_of and first != self.unknown and self.pieces[first][0] == MARK else text


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, n_tokens, ids (array<int>) and decoded_sha256 for every row; `path`: a SentencePiece .model."""

    def make():
        codec = PieceCodec(path)

        def work(texts: list[str]) -> tuple[list, ...]:
            n, ids, back = codec.digest(texts)
            flat = np.fromstring(",".join(x for x in ids if x), dtype=np.int32, sep=",")
            return n, np.split(flat, np.cumsum(n)[:-1]), [sha(x) for x in back]

        return work

    fields = [("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType())), ("decoded_sha256", T.StringType())]
    return map_texts(docs, text_col, [id_col], fields, make)


def digest_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, n_tokens, ids_sha256, decoded_sha256: the digests of what encode_pieces returns, made beside it."""

    def make():
        codec = PieceCodec(path)

        def work(texts: list[str]) -> tuple[list, ...]:
            n, ids, back = codec.digest(texts)
            return n, [sha(x) for x in ids], [sha(x) for x in back]

        return work

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return map_texts(docs, text_col, [id_col], fields, make)
