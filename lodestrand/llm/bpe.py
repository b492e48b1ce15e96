"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of the last bytes meets a mask, so the same
passage yields the same chunks in whatever document it stands. A chunk is
encoded once per worker process, whose tasks share the tables, and then reused; the words of a new chunk go through a
second, finer reuse table, and only words that neither table holds reach the
tokenizer, in one batch. A cut may fall inside a word: both sides then carry ids
that the whole text would not have. Each such join is repaired by encoding the
word across it anew together with its neighbours, widened until the neighbours'
ids agree with those of their chunks, at the latest when the whole text has
been encoded.

All of it is local to a row: no shuffle, and a lost executor costs only its
tasks. The reuse tables are bounded by bytes and hold two generations, so
memory does not grow with the corpus; dropping an entry costs a re-encoding,
never a result.

The method holds for tokenizers whose words end at ASCII white space, which
`words_end_at_space` tests when a worker starts; for others every text is
encoded whole.

Defined cases: null is taken as empty; an empty text has no ids and decodes to
an empty text; texts of any length are encoded whole; rows are independent, so
repeated rows and ids do not matter; other columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, slices

#: Chunks end where the lowest bits of the hash are zero: 2**11 bytes long on average.
MASK_BITS, WINDOW = 11, 14
WORD_TABLE_BYTES, CHUNK_TABLE_BYTES = 160 << 20, 12 << 20
#: New words that the tokenizer encodes in one call.
WORDS_A_CALL = 8192
SPACES = b" \t\n\r\x0b\x0c"


class Reuse:
    """A dictionary bounded by bytes: when the young generation is full, the old one is dropped."""

    def __init__(self, most: int):
        self.young, self.old, self.held, self.most = {}, {}, 0, most

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.young[key] = found
        return found

    def put(self, key, value, size: int) -> None:
        self.put_all({key: value}, size)

    def put_all(self, entries: dict, size: int) -> None:
        self.young.update(entries)
        self.held += size
        if self.held > self.most // 2:
            self.old, self.young, self.held = self.young, {}, 0


def cut_points(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """Positions after which a chunk ends: decided by the last WINDOW bytes, always before the first byte of a character."""
    n = len(data)
    if n <= WINDOW:
        return np.empty(0, np.int64)
    mixed = gear[data]
    rolled = np.zeros(n, np.uint16)
    for k in range(WINDOW):
        rolled[k:] += mixed[: n - k] << np.uint16(k)
    ends = (rolled & np.uint16(2**MASK_BITS - 1)) == 0
    ends[: WINDOW - 1] = False
    ends[:-1] &= (data[1:] & 0xC0) != 0x80
    return np.nonzero(ends)[0] + 1


def gear_table() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**16, 256, dtype=np.uint16)


class Codec:
    """Encodes and decodes UTF-8 texts with one tokenizer; ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words, self.chunks, self.gear = Reuse(WORD_TABLE_BYTES), Reuse(CHUNK_TABLE_BYTES), gear_table()
        self.local = self.words_end_at_space()

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decoded(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def words_end_at_space(self) -> bool:
        """Whether words on both sides of white space encode as they do alone, and decode to parts joined by a space."""
        probes = ["It's", "don't", "a1b2", "...", "x,y", "Éa", "l'été", "--", "<|endoftext|>", "ß", "42%", "'s"]
        alone = self.ids_of(probes)
        for a, one in zip(probes, alone):
            for b, two in zip(probes, alone):
                for gap in (" ", "\n", "\t ", "\r\n"):
                    whole = self.ids_of([a + gap + b])[0]
                    if whole != one + two or self.decoded([whole])[0] != " ".join(self.decoded([one, two])):
                        return False
        return True

    def encode_words(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded text) of each word; words that the table lacks are encoded in one batch."""
        found = list(map(self.words.young.get, words))
        if None in found:
            made = self.learn({w for w, x in zip(words, found) if x is None})
            found = [x or made[w] for w, x in zip(words, found)]
        return found

    def learn(self, words: set[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """(ids, decoded text) of words that the young table lacks, which holds them then."""
        made = {w: self.words.old.get(w) for w in words}
        new = [w for w, x in made.items() if x is None]
        for at in range(0, len(new), WORDS_A_CALL):
            some = new[at : at + WORDS_A_CALL]
            ids = self.ids_of([w.decode() for w in some])
            flat = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
            ends = [4 * n for n in accumulate(map(len, ids), initial=0)]
            for w, a, b, t in zip(some, ends, ends[1:], self.decoded(ids)):
                made[w] = (flat[a:b], t.encode())
        self.words.put_all(made, 330 * len(made) + 4 * sum(len(x[0]) for x in made.values()))
        return made

    def learn_chunks(self, texts: list[bytes], cuts: list[list[int]]) -> None:
        """The words of all chunks that the chunk table lacks go to the tokenizer together, not chunk by chunk."""
        words, looked = set(), set()
        for text, ends in zip(texts, cuts):
            bounds = [0, *ends, len(text)]
            for a, b in zip(bounds, bounds[1:]):
                data = text[a:b]
                if data not in looked and self.chunks.get(data) is None:
                    looked.add(data)
                    words.update(data.split())
        self.learn(words - self.words.young.keys())

    def chunk(self, data: bytes) -> tuple[bytes, bytes, bytes, bytes, int]:
        """The chunk encoded by itself: ids, decoded text, first word, last word, number of words."""
        entry = self.chunks.get(data)
        if entry is None:
            words = data.split()
            parts = self.encode_words(words)
            first, last = (words[0], words[-1]) if words else (b"", b"")
            entry = (b"".join([x[0] for x in parts]), b" ".join([x[1] for x in parts if x[0]]), first, last, len(words))
            self.chunks.put(data, entry, len(data) + len(entry[0]) + len(entry[1]) + 400)
        return entry

    def joined(self, data: bytes, cuts: list[int]) -> tuple[bytes, bytes, list[int]]:
        """Ids and decoded text of one whole text from chunks that end at `cuts`, and the cuts that fell inside a word."""
        ids, texts, inside, pending = [], [], [], b""
        bounds = [0, *cuts, len(data)]
        for a, b in zip(bounds, bounds[1:]):
            if a == b:
                continue
            own, text, first, last, n = self.chunk(data[a:b])
            goes_on = b < len(data) and data[b - 1] not in SPACES and data[b] not in SPACES
            if goes_on:
                inside.append(b)
            if pending:
                if goes_on and n == 1 and data[a] not in SPACES:
                    pending += first  # one word fills the whole chunk and crosses its end as well
                    continue
                own, text = self._without(own, text, first, left=True)
                self._add(ids, texts, *self.encode_words([pending + first])[0])
                pending = b""
            if goes_on:
                own, text = self._without(own, text, last, left=False)
                pending = last
            self._add(ids, texts, own, text)
        return b"".join(ids), b" ".join(texts), inside

    def _without(self, ids: bytes, text: bytes, word: bytes, left: bool) -> tuple[bytes, bytes]:
        """A chunk's encoding without its first or last word, of which another part lies beyond the cut."""
        a, t = self.encode_words([word])[0]
        if not a:
            return ids, text
        if left:
            return ids[len(a) :], text[len(t) + 1 :]
        return ids[: len(ids) - len(a)], text[: max(0, len(text) - len(t) - 1)]

    @staticmethod
    def _add(ids: list[bytes], texts: list[bytes], a: bytes, t: bytes) -> None:
        if a:
            ids.append(a)
            texts.append(t)

    @staticmethod
    def window(data: bytes, cut: int, reach: int) -> tuple[int, int]:
        """The text about a cut, from white space to white space at least `reach` bytes away, or to the ends of the text."""
        lo = next((i + 1 for i in range(max(0, cut - reach) - 1, -1, -1) if data[i] in SPACES), 0)
        hi = next((i for i in range(cut + reach, len(data)) if data[i] in SPACES), len(data))
        return lo, hi

    def encode_many(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids and decoded text of each whole text."""
        if not self.local:
            return [self._whole(t) for t in texts]
        data = np.frombuffer(b"".join(texts), np.uint8)
        found, at, cuts, out, open_joins = cut_points(data, self.gear), 0, [], [], []
        for text in texts:
            # A hash that reaches back into the text before says nothing about this one.
            lo, hi = np.searchsorted(found, (at + WINDOW, at + len(text)))
            cuts.append((found[lo:hi] - at).tolist())
            at += len(text)
        self.learn_chunks(texts, cuts)
        for k, text in enumerate(texts):
            ids, decoded, inside = self.joined(text, cuts[k])
            out.append((ids, decoded))
            open_joins += [(k, cut) for cut in inside]
        reach = 16
        while open_joins:
            windows = [(k, cut, *self.window(texts[k], cut, reach)) for k, cut in open_joins]
            anew = self.ids_of([texts[k][lo:hi].decode() for k, _, lo, hi in windows])
            open_joins = []
            for (k, cut, lo, hi), ids in zip(windows, anew):
                parts = self.encode_words(texts[k][lo:hi].split())
                if np.array(ids, "<u4").tobytes() == b"".join([x[0] for x in parts]):
                    continue
                if lo == 0 and hi == len(texts[k]):
                    out[k] = self._whole(texts[k])
                else:
                    open_joins.append((k, cut))
            reach *= 4
        return out

    def _whole(self, data: bytes) -> tuple[bytes, bytes]:
        ids = self.ids_of([data.decode()])
        return np.array(ids[0], "<u4").tobytes(), self.decoded(ids)[0].encode()


CODECS: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    """The codec of this worker process: tasks that follow one another share its tables."""
    if path not in CODECS:
        CODECS.clear()
        CODECS[path] = Codec(path)
    return CODECS[path]


def encoded(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ids as a binary column of little-endian unsigned 32-bit integers."""
    return _mapped(docs, tokenizer_path, doc_id, text, "doc_id long, ids binary, decoded binary", lambda i, t: (i, t))


def digests(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _mapped(docs, tokenizer_path, doc_id, text, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda i, t: (len(i) // 4, sha(i), sha(t)))


def _mapped(docs: DataFrame, path: str, doc_id: str, text: str, schema: str, of) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[x.split()[1]] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in slices(batches, "text"):
            gc.disable()  # the tables hold no cycles, and each collection would walk through new entries
            try:
                rows = [of(*x) for x in codec.encode_many([t or b"" for t in as_bytes(batch.column("text"))])]
            finally:
                gc.enable()
            columns = [pa.array([r[k] for r in rows], kinds[k + 1]) for k in range(len(kinds) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, schema)
