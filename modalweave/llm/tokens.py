"""Token ids of whole texts by a public tokenizer, chunk by chunk.

A text is cut only where the tokenizer's own pre-tokenisation always cuts: before ASCII white space, and between an ASCII
letter or digit and the punctuation that ends its word. The ids of a text are therefore those of its chunks, one after
another, and a chunk met before in the same worker need not be encoded again. How many chunks a worker remembers is a
parameter: they are held in two generations of that size, and a chunk met again moves to the younger. When the younger is
full, the elder is forgotten, so frequent chunks stay, memory is bounded and ids never change.
"""

from __future__ import annotations

import ctypes
import os
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LETTER = np.isin(np.arange(256), list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
PUNCTUATION = (np.arange(256) > 32) & (np.arange(256) < 127) & ~LETTER
#: Bytes of texts whose chunks are told apart together.
TOGETHER = 4 << 20
#: Chunks in each of the two generations that a worker remembers, about 200 bytes each.
MEMORY = 250_000
#: Chunks that a worker keeps between tasks that share it with other stages.
KEPT = 50_000
#: A text marker that the vocabularies hold as one special id; it parts chunks that are encoded together.
MARK = "<|endoftext|>"


def give_back() -> None:
    """Hand free memory back to the system, where the C library offers it."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class ChunkEncoder:
    """Ids as little-endian unsigned 32-bit integers."""

    _shared: dict[tuple, ChunkEncoder] = {}

    def __init__(self, path: str, spaces: bool, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        names = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        # A text with such a name, in any case, is encoded whole: the tokenizer takes names out before it splits a text.
        pattern = "|".join(map(re.escape, names)) or "(?!)"
        self.named = re.compile(pattern, re.I)
        self.names = re.compile(pattern.encode(), re.I)
        self.mark = self.plain.token_to_id(MARK)
        self.spaces, self.memory = spaces, memory
        self.known: dict[bytes, bytes] = {}
        self.elder: dict[bytes, bytes] = {}
        self.unsafe: set[bytes] = set()

    @classmethod
    def shared(cls, path: str, spaces: bool, memory: int = MEMORY) -> ChunkEncoder:
        """One encoder for each tokenizer and worker process. spaces: white space has ids of its own."""
        key = (path, spaces, memory)
        if key not in cls._shared:
            cls._shared[key] = cls(path, spaces, memory)
        return cls._shared[key]

    def _whole(self, text: str) -> bytes:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _marked(self, text: str) -> np.ndarray:
        """The ids of a text in which marks count as marks."""
        return np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _together(self, chunks: list[bytes]) -> None:
        for lo in range(0, len(chunks), 2048):
            part = chunks[lo : lo + 2048]
            texts = [c.decode() for c in part]
            ids = self._marked(MARK.join(texts))
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(part) - 1 or any("<|" in t for t in texts):
                self.known.update((c, self._whole(t)) for c, t in zip(part, texts, strict=True))
                continue
            raw, ends = ids.tobytes(), [*(cuts * 4).tolist(), len(ids) * 4]
            at = 0
            for c, end in zip(part, ends, strict=True):
                self.known[c] = raw[at:end]
                at = end + 4

    def _learn(self, missing: set[bytes]) -> None:
        for c in missing & self.elder.keys():
            self.known[c] = self.elder[c]
        new = [c for c in missing if c not in self.known]
        if self.spaces:
            for c in new:
                if not c.isascii():
                    last = c[-3:].decode("utf-8", "ignore")[-1:]
                    if last.isspace() and not last.isascii():
                        self.unsafe.add(c)  # with white space after it, the run of white space would be cut
        self._together(new)

    def _parts(self, raw: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Where the chunks of the texts begin, each chunk with the white space before it. texts: where texts begin."""
        blank = BLANK[raw]
        first = np.empty(len(raw), bool)
        first[:1], first[1:] = True, blank[1:] & ~blank[:-1]
        first[texts[texts < len(raw)]] = True
        # A word that ends in punctuation: the run of it has a letter or digit before it and ends with its chunk.
        marks = PUNCTUATION[raw]
        tails = np.flatnonzero(marks[1:] & LETTER[raw[:-1]] & ~first[1:]) + 1
        ends = np.flatnonzero(~marks | first)
        end = np.append(ends, len(raw))[np.searchsorted(ends, tails)]
        closed = np.append(first, True)[end]
        first[tails[closed]] = True
        return np.flatnonzero(first)

    def _ids(self, chunks: list[bytes]) -> tuple[list[bytes], list[int]]:
        """The ids of distinct chunks, and the places of those that can't be encoded apart from what follows."""
        if not self.spaces:
            chunks = [c.strip().lower() for c in chunks]
        if len(self.known) > self.memory:
            self.unsafe.intersection_update(self.known)
            self.known, self.elder = {}, self.known
        found = list(map(self.known.get, chunks))
        missing = {c for c, i in zip(chunks, found, strict=True) if i is None and c}
        if missing:
            self._learn(missing)
            found = [self.known.get(c, b"") if i is None else i for c, i in zip(chunks, found, strict=True)]
        return found, [i for i, c in enumerate(chunks) if c in self.unsafe] if self.unsafe else []

    def _encoded(self, texts: pa.Array) -> Iterator[bytes]:
        """Each distinct chunk of some texts is looked up once; the ids are then gathered by number."""
        size, offsets = len(texts), np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        begins = offsets[:-1] - offsets[0]
        starts = self._parts(raw, begins)
        ends = np.append(starts[1:], len(raw)).astype(np.int64)
        bounds = pa.py_buffer(np.append(starts, len(raw)).astype(np.int64))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(raw)]).dictionary_encode()
        number = chunks.indices.to_numpy()
        ids, unsafe = self._ids(chunks.dictionary.to_pylist())
        length = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        place, own = np.cumsum(length, dtype=np.int32) - length, length[number]
        total = np.cumsum(own, dtype=np.int32)
        at = np.repeat(place[number] - (total - own), own)
        at += np.arange(len(at), dtype=np.int32)
        out = np.frombuffer(b"".join(ids), "<u4")[at].tobytes()
        # Of each text the first chunk, and the ids before it; an empty text has none of its own.
        to = np.concatenate([[0], total]).astype(np.int64)[np.searchsorted(ends, np.append(begins, len(raw)), "right")] * 4
        whole = set(np.searchsorted(begins, starts[np.isin(number, unsafe)], "right") - 1) if unsafe else set()
        named = self.names.search(memoryview(raw)) is not None
        for i in range(size):
            if i in whole or named and self.named.search(texts[i].as_py()) is not None:
                yield self._whole(texts[i].as_py())
            else:
                yield out[to[i] : to[i + 1]]

    def encode(self, texts: pa.Array | Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order; a null text has none."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        lengths = pc.binary_length(texts).to_numpy()
        lo, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > TOGETHER:
                yield from self._encoded(texts.slice(lo, i - lo))
                lo, held = i, 0
            held += n
        if len(texts) > lo:
            yield from self._encoded(texts.slice(lo))

    def rest(self, keep: int = KEPT) -> None:
        """Keep the chunks learnt first, which are the frequent ones; a worker may live on, idle, for long, and other
        stages need the memory."""
        self.elder = {}
        self.known = dict(islice(self.known.items(), keep))
        self.unsafe.intersection_update(self.known)
        pa.default_memory_pool().release_unused()
        give_back()
