"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of the last 32 bytes meets a mask, so that passages shared by documents
give the same chunks wherever they stand. A chunk met again by the same worker is not encoded again: the
chunks used last are kept, by a digest, up to a bound in bytes. Chunks are encoded on their own, which can
differ from the whole text's ids around a join: there a window from the last place in front of the join to
the first one after it at which a chunk's own ids agree with those of its part is encoded anew, and replaces
what the chunks had. Where a chunk has no such place, the window grows over it to the next chunk, and is
encoded once when it ends: every byte is encoded at most twice, whatever the text.

Such places are those at which the tokenizer's split pattern always starts a new piece: after a character
that is not white space, at a space before another such one, or where letters, digits and other characters
meet (not between an apostrophe and a letter).

Null texts count as empty (no ids). Very long texts are chunked like others; the memory is that of one
document's ids. Documents without any cut form one chunk. Repeated rows give repeated results. Other columns
are not read, so that their names cannot clash.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, strings

#: The string that the vocabulary adds as a token of its own, and its id.
ADDED, ADDED_ID = "<|endoftext|>", 50256
#: A cut falls on one in CUT_EVERY positions, at least CUT_LEAST bytes after the last.
CUT_EVERY, CUT_LEAST = 2048, 512
CHUNK_CACHE_BYTES = 24 << 20

_AGREE = r"(?<=\S)(?=\x20\S)|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}\p{M}\p{Cn}])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=[^\s\p{L}\p{N}\p{M}\p{Cn}])(?=\p{N})|(?<=[^\s\p{L}\p{N}\p{M}\p{Cn}'’])(?=\p{L})"
_first, _last = regex.compile(_AGREE), regex.compile("(?r)" + _AGREE)


class ByteBpe:
    """Byte-level BPE: ids as little-endian unsigned 32-bit bytes, equal to those of the tokenizers library."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        # from the library's own file: a Tokenizer made only to be asked would stay in the worker's memory
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        chars = _byte_characters()
        ranks = {bytes(chars[c] for c in token): i for token, i in model["vocab"].items() if i != ADDED_ID}
        del model
        self.table: list[bytes] = [b""] * (max([*ranks.values(), ADDED_ID]) + 1)
        for token, i in ranks.items():
            self.table[i] = token
        self.table[ADDED_ID] = ADDED.encode()
        self.core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.chunks: OrderedDict[bytes, tuple[bytes, int, int, int, int] | None] = OrderedDict()
        self.chunk_bytes = 0
        self.met = self.reused = self.repairs = 0

    def plain(self, text: str) -> bytes:
        return np.array(self.core.encode_ordinary(text), dtype="<u4").tobytes()

    def _encoded(self, text: str) -> tuple[bytes, int, int, int, int] | None:
        """Of a chunk: ids, the end of its head and the bytes of that part's ids, the same of all but its tail; None without places."""
        head, tail = _first.search(text, 1), _last.search(text, 1, len(text) - 1)
        if head is None or tail is None or head.start() >= len(text):
            return None
        ids, a, b = self.plain(text), head.start(), tail.start()
        first, last = self.plain(text[:a]), self.plain(text[b:])
        if not (ids.startswith(first) and ids.endswith(last)):
            return None
        return ids, a, len(first), b, len(ids) - len(last)

    def chunk(self, text: str) -> tuple[bytes, int, int, int, int] | None:
        key = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        self.met += 1
        if key in self.chunks:
            self.reused += 1
            self.chunks.move_to_end(key)
            return self.chunks[key]
        got = self.chunks[key] = self._encoded(text)
        self.chunk_bytes += _cost(got)
        while self.chunk_bytes > CHUNK_CACHE_BYTES:
            self.chunk_bytes -= _cost(self.chunks.popitem(last=False)[1])
        return got

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        if ADDED in text:
            return np.uint32(ADDED_ID).astype("<u4").tobytes().join(self.encode(part) if part else b"" for part in text.split(ADDED))
        parts = cuts(text)
        if len(parts) == 1:
            return self.plain(text) if text else b""
        out, window = [], [""]
        for part in parts:
            got = self.chunk(part)
            if got is None:
                window.append(part)
                continue
            ids, head, head_ids, tail, tail_ids = got
            if len(out) or window != [""]:
                self.repairs += 1
                out.append(self.plain("".join([*window, part[:head]])))
                out.append(ids[head_ids:tail_ids])
            else:
                out.append(ids[:tail_ids])
            window = [part[tail:]]
        out.append(self.plain("".join(window)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become the replacement character."""
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


def _cost(chunk: tuple | None) -> int:
    return 300 + (len(chunk[0]) if chunk else 0)


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte: the byte's own where printable, else the next from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {chr(b if b in own else next(spare)): b for b in range(256)}


_gear = np.random.default_rng(20240501).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes that end at each place, by doubling the window five times."""
    h = _gear[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def cuts(text: str) -> list[str]:
    """The content-defined chunks of a text."""
    if len(text) <= CUT_LEAST:
        return [text]
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, dtype=np.uint8)
    hits = np.flatnonzero(rolling(raw) < np.uint32((1 << 32) // CUT_EVERY)) + 1
    out, last = [], 0
    for at in hits.tolist():
        while at < len(data) and data[at] & 0xC0 == 0x80:  # not inside a character
            at += 1
        if at - last >= CUT_LEAST and at < len(data):
            out.append(data[last:at].decode("utf-8", "surrogatepass"))
            last = at
    out.append(data[last:].decode("utf-8", "surrogatepass"))
    return out


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder per worker process and vocabulary."""
    return ByteBpe(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """id, n_tokens, the ids (optional), and digests of the ids and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for b in batches:
            n, ids_of, a, d = [], [], [], []
            for text in strings(b.column(1)):
                ids = bpe.encode(text)
                n.append(len(ids) // 4)
                if keep_ids:
                    ids_of.append(np.frombuffer(ids, dtype="<u4").astype(np.int32))
                a.append(hashlib.sha256(ids).hexdigest())
                d.append(hashlib.sha256(bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols.append(pa.array(ids_of, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), schema)
