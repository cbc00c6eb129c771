"""SentencePiece BPE encoding with byte offsets, and decoding.

Normalisation takes, at each position, the longest rule of the model's compiled character map and notes for
every byte written where it came from. Pieces are found in the normalised text, so each one projects to a byte
span of the original text.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm.tables import pieces, table

SPACE = "▁"
MEMO_WORDS = 100_000
SLICE_BYTES = 1 << 18  # words, places and spans of a slice take some hundred times its size
LONG_WORD = 64
# fixed values: field numbers and type codes of the public model format
_PIECE, _TRAINER, _NORMALIZER = 1, 2, 3
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_MODEL_TYPE, _BPE, _BYTE_FALLBACK, _SUFFIX = 3, 2, 35, 24
_CHARSMAP, _DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE = 2, 3, 4, 5


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at:at + size]
            at += size


class CharacterMap:
    """Longest-prefix rules of a compiled character map: a double-array trie and its replacement strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], dtype="<u4").tolist()
        self.strings = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest rule that matches `text` at `at`."""
        if not self.units:
            return None
        found, node = None, self._child_base(self.units[0], 0)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node = self._child_base(unit, node)
            if unit >> 8 & 1:
                begin = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.strings[begin:self.strings.index(0, begin)]
        return found

    @staticmethod
    def _child_base(unit: int, node: int) -> int:
        return node ^ (unit >> 10) << ((unit & 1 << 9) >> 6)


class PieceModel:
    """Pieces, rules and flags of a BPE model file with byte fallback."""

    def __init__(self, data: bytes):
        entries, trainer, normalizer = [], {}, {}
        for field, value in _fields(data):
            if field == _PIECE:
                entries.append(dict(_fields(value)))
            elif field == _TRAINER:
                trainer = dict(_fields(value))
            elif field == _NORMALIZER:
                normalizer = dict(_fields(value))
        kinds = [e.get(3, _NORMAL) for e in entries]
        if trainer.get(_MODEL_TYPE) != _BPE or not trainer.get(_BYTE_FALLBACK) or trainer.get(_SUFFIX) or {_USER, _UNUSED} & set(kinds):
            raise ValueError("needs a BPE model with byte fallback and without user-defined or unused pieces")
        names = [e[1].decode() for e in entries]
        self.score = {n: struct.unpack("<f", e.get(2, b"\0\0\0\0"))[0] for n, e, k in zip(names, entries, kinds) if k == _NORMAL}
        self.id = {n: i for i, (n, k) in enumerate(zip(names, kinds)) if k == _NORMAL}
        self.byte_id = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(names, kinds)) if k == _BYTE}
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        self.width = np.array([len(n.encode()) if k == _NORMAL else int(k == _BYTE) for n, k in zip(names, kinds)], dtype=np.int64)
        self.rules = CharacterMap(normalizer.get(_CHARSMAP, b""))
        self.prefix, self.trim = normalizer.get(_DUMMY_PREFIX, 1), normalizer.get(_EXTRA_SPACES, 1)
        self.space = SPACE if normalizer.get(_ESCAPE, 1) else " "
        # spaces open a piece and never follow other characters inside one: words then merge apart from each other
        inner = any(self.space in n.lstrip(self.space) for n in self.id)
        self.words = re.compile(".+" if inner else f"{self.space}*[^{self.space}]+|{self.space}+", re.DOTALL)
        self.memo: dict[str, bytes] = {}
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for every byte of it and its end the byte of `text` it comes from."""
        raw = text.encode()
        if not raw:
            return "", np.zeros(1, dtype=np.int64)
        if not self.rules.units and not self.trim:
            return self._with_spaces(text, raw)
        out, source, at = bytearray(), [], 0
        for size, new in self._rewritten(raw):
            out += new
            source += [at] * len(new)
            at += size
        source.append(at)
        if self.trim:  # no spaces at the ends and one between words
            spaces = [i for i, b in enumerate(out) if b == 32]
            first = next((i for i, b in enumerate(out) if b != 32), len(out))
            last = next((i for i in range(len(out) - 1, -1, -1) if out[i] != 32), -1)
            gone = {i for i in spaces if i < first or i > last or out[i - 1] == 32}
            end = source[last + 1] if first < len(out) else at
            source = [s for i, s in enumerate(source[:-1]) if i not in gone] + [end]
            out = bytearray(b for i, b in enumerate(out) if i not in gone)
        if not out:
            return "", np.array([source[-1]], dtype=np.int64)
        return self._escaped(bytes(out), np.array(source, dtype=np.int64))

    def _rewritten(self, raw: bytes) -> Iterator[tuple[int, bytes]]:
        """(bytes read, bytes written), step by step."""
        at = 0
        while at < len(raw):
            rule = self.rules.longest(raw, at)
            if rule is None:
                lead = raw[at]
                size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                rule = size, raw[at:at + size]
            yield rule
            at += rule[0]

    def _escaped(self, out: bytes, source: np.ndarray) -> tuple[str, np.ndarray]:
        """As `_with_spaces`, with the bytes of the original text as sources."""
        text, plain = self._with_spaces(out.decode(), out)
        return text, source[plain]

    def _with_spaces(self, text: str, raw: bytes) -> tuple[str, np.ndarray]:
        """Spaces as the space mark after the dummy prefix, with the source of every byte."""
        wide = len(self.space.encode())
        times = np.where(np.frombuffer(raw, dtype=np.uint8) == 32, wide, 1)
        source = np.append(np.repeat(np.arange(len(raw)), times), len(raw))
        new = text.replace(" ", self.space)
        if self.prefix:
            new, source = self.space + new, np.concatenate((np.full(wide, source[0]), source))
        return new, source

    def merge(self, word: str) -> list[str]:
        """Symbols of a word after all merges: best score first, of equal scores the leftmost."""
        parts = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < len(parts):
                joined = parts[left] + parts[right]
                if joined in self.score:
                    heapq.heappush(queue, (-self.score[joined], left, joined))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, left, joined = heapq.heappop(queue)
            right = after[left]
            if not parts[left] or right >= len(parts) or len(parts[left]) + len(parts[right]) != len(joined) or parts[left] + parts[right] != joined:
                continue  # one of the two has been merged since
            parts[left], parts[right] = joined, ""
            after[left] = after[right]
            if after[left] < len(parts):
                before[after[left]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        return [p for p in parts if p]

    def word_ids(self, word: str) -> bytes:
        """Ids of a normalised word as 32-bit integers."""
        ids = []
        for part in self.merge(word):
            ids += [self.id[part]] if part in self.id else [self.byte_id[b] for b in part.encode()]
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, words: set[str]) -> None:
        """Puts the ids of new words into a memo of bounded size.

        Where normalisation only marks spaces, words after one space go to the library in one call, which is
        faster; its own dummy prefix stands for the space.
        """
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        new = words.difference(self.memo)
        if not self.rules.units and not self.trim and self.prefix and self.space == SPACE:
            plain = [w for w in new if w[0] == SPACE and 1 < len(w) <= LONG_WORD and w[1] != SPACE]
            for w, ids in zip(plain, self.library.encode([w[1:] for w in plain], num_threads=1)):
                self.memo[w] = struct.pack(f"<{len(ids)}I", *ids)
            new.difference_update(plain)
        for w in new:
            self.memo[w] = self.word_ids(w)

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text (ids with begin and end, first byte and end byte of each; a byte piece spans its own byte)."""
        normal = [self.normalise(t) for t in texts]
        words = [self.words.findall(new) for new, _ in normal]
        known = set().union(*words)
        self.learn(known)
        out, ids_of = [], self.memo.__getitem__
        for split, (_, source) in zip(words, normal):
            body = np.frombuffer(b"".join(map(ids_of, split)), dtype="<u4")
            ids = np.concatenate(([self.begin], body, [self.end]), dtype=np.int64)
            at = np.concatenate(([0], np.cumsum(self.width[ids])))
            out.append((ids, source[at[:-1]], source[at[1:]]))
        for w in known:
            if len(w) > LONG_WORD:
                del self.memo[w]
        return out


@functools.lru_cache(maxsize=2)
def load_model(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read())


def _encoded(model_path: str):
    kinds = (("ids", np.int32), ("begins", np.int32), ("ends", np.int32))

    def run(batches):
        model = load_model(model_path)
        for part in pieces(batches, 0, SLICE_BYTES):
            texts = pc.fill_null(part.column(0), "").to_pylist()
            rows = model.encode_all(texts)
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(r[0]) for r in rows]))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[i] for r in rows]).astype(t))) for i, (_, t) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *lists], names=[*part.schema.names[1:], *(n for n, _ in kinds)])

    return run


def encode_pieces(docs: DataFrame, model_path: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns `carry` (all but the text by default) with ids, begins and ends (arrays; byte spans in the text, end exclusive).

    Ids are those of the sentencepiece library, with begin and end ids. Null and empty texts give these two only.
    `model_path` is a file that every executor has at that path.
    """
    carry = [c for c in ([c for c in docs.columns if c != text] if carry is None else carry) if c not in ("ids", "begins", "ends")]
    source = docs.select(F.col(text).alias("_text"), *carry)
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[1:])
    return source.mapInArrow(_encoded(model_path), kept + "ids array<int>, begins array<int>, ends array<int>")


def _decoded(model_path: str, names: list[str], ids: str):
    def run(batches):
        library = load_model(model_path).library
        for batch in batches:
            lists = batch.column(names.index(ids))
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                known = pc.fill_null(lists.slice(lo, 200), pa.scalar([], lists.type))
                offsets = known.offsets.to_numpy()
                flat = known.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).tolist()
                cuts = (offsets - offsets[0]).tolist()
                # one list at a time: the library's own threads cost more than they save inside a task
                texts = [library.decode(flat[a:b]) if a < b else "" for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return run


def decode_pieces(encoded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """All columns with `decoded`, the text of the ids by the library's decode; null and empty lists give an empty text."""
    fields = [f for f in encoded.schema.fields if f.name != "decoded"]
    source = encoded.select(*[f.name for f in fields])
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "decoded string"
    return source.mapInArrow(_decoded(model_path, source.columns, ids), schema)


def model_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _digest(batches):
    """ids as little-endian 32-bit integers and the decoded text, both by SHA-256."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("ids"))
        ids = [hashlib.sha256(np.asarray(x.values, dtype="<u4").tobytes()).hexdigest() for x in lists]
        texts = [hashlib.sha256(t.encode()).hexdigest() for t in batch.column(batch.schema.get_field_index("decoded")).to_pylist()]
        n = pc.list_value_length(lists).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                                         names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def op4_sentencepiece(spark, sf_dir):
    """Encoding, decoding and digests as one chain inside each task: ids and decoded texts never go back to the JVM."""
    path = model_file()
    encode, decode = _encoded(path), _decoded(path, ["doc_id", "ids", "begins", "ends"], "ids")
    docs = table(spark, sf_dir, "documents").select("text", "doc_id")
    return docs.mapInArrow(lambda batches: _digest(decode(encode(batches))), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
