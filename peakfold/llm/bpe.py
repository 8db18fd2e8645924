"""Byte-pair encoding with a minimal acyclic transducer as lexicon, and decoding.

The lexicon is a minimal automaton over the bytes of frequent words; walking a word adds up the
outputs of its arcs to the word's rank, which names its ids. It is compiled once on the driver into
flat arrays, shipped as one file, and memory-mapped by each worker. Words that it lacks are merged
exactly, lowest rank first. Both give the ids that the tokenizer's own merges give.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from peakfold.llm.common import IdMemo, Ship, id_text, map_arrow, out_batch, shipped_file, slices, texts_of

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Fixed value: the published pre-tokenisation pattern of byte-level BPE.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words of more bytes are merged one at a time from a heap: steps over all words would be too many.
LONG_WORD = 512
#: A blank that other white space or the end follows: such texts are cut only before words.
ODD_BLANK = regex.compile(r" (?:\s|\Z)")
BEFORE_WORD = regex.compile(r"(?= \S)")


@functools.cache
def newer_letters() -> str:
    """Ranges of a character class: letters and digits that ``regex`` knows and the tokenizers library doesn't yet.

    Only code points that Python's own tables lack can be such; the library itself is asked for these.
    """
    from tokenizers import pre_tokenizers

    found = [c for c in regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)) if unicodedata.category(c) == "Cn"]
    out: list[list[int]] = []
    for c, mate in ((c, "a" if regex.match(r"\p{L}", c) else "1") for c in found):
        if len(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(mate + c)) == 1:
            continue
        if out and out[-1][1] == ord(c) - 1:
            out[-1][1] += 1
        else:
            out.append([ord(c), ord(c)])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files of byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Merges, bytes of each id and added tokens, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.token_bytes = [b""] * (max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1)
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token) if token not in self.added else token.encode()
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = [0] * 256
        for c, b in alphabet.items():
            self.byte_ids[b] = vocab[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: while a known pair is left, joins the leftmost one of the lowest rank."""
        ids = [self.byte_ids[b] for b in word]
        get = self.merges.get
        while len(ids) > 1:
            best = min((m for m in map(get, zip(ids, ids[1:])) if m), default=None)  # noqa: B905
            if best is None:
                break
            out, k, last = [], 0, len(ids) - 1
            while k <= last:
                if k < last and get((ids[k], ids[k + 1])) == best:
                    out.append(best[1])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def merge_long(self, word: bytes) -> list[int]:
        """merge() of a long word: known pairs wait in a heap, by rank and place, as neighbours change."""
        ids = [self.byte_ids[b] for b in word]
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], k, m[1], ids[k], ids[k + 1]) for k in range(n - 1) if (m := get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, new, a, b = heapq.heappop(heap)
            j = after[k]
            if j >= n or ids[k] != a or ids[j] != b:
                continue
            ids[k], ids[j], after[k] = new, -1, after[j]
            if after[j] < n:
                before[after[j]] = k
                if m := get((new, ids[after[j]])):
                    heapq.heappush(heap, (m[0], k, m[1], new, ids[after[j]]))
            if (i := before[k]) >= 0 and (m := get((ids[i], new))):
                heapq.heappush(heap, (m[0], i, m[1], ids[i], new))
        return [i for i in ids if i >= 0]

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """merge() of many words at once: each step joins, in every word left, its pair of the lowest rank."""
        out: list = [self.merge_long(w) if len(w) > LONG_WORD else [] for w in words]
        words = [w if len(w) <= LONG_WORD else b"" for w in words]
        raw = np.frombuffer(b"".join(words), np.uint8)
        if not len(raw):
            return out
        ids, word = np.array(self.byte_ids, np.int64)[raw], np.repeat(np.arange(len(words)), [len(w) for w in words])
        if not hasattr(self, "_pairs"):
            order = sorted(self.merges, key=lambda p: p[0] << 32 | p[1])
            self._pairs = np.array([a << 32 | b for a, b in order], np.int64)
            self._ranks, self._joined = (np.array([self.merges[p][k] for p in order], np.int64) for k in (0, 1))
        none = np.iinfo(np.int64).max

        def look_up(at):
            """Place of the pair that begins at each position, and its rank."""
            key = ids[at] << 32 | ids[at + 1]
            pos = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
            return pos, np.where((self._pairs[pos] == key) & (word[at] == word[at + 1]), self._ranks[pos], none)

        pair, rank = np.zeros(len(ids), np.int64), np.full(len(ids), none)
        pair[:-1], rank[:-1] = look_up(np.arange(len(ids) - 1))
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff([*first, len(ids)])
            low = np.repeat(np.minimum.reduceat(rank, first), size)
            if (over := low == none).any():
                ends = first[over[first]]
                for a, n in zip(ends.tolist(), size[over[first]].tolist(), strict=True):
                    out[word[a]] = ids[a : a + n].tolist()
                ids, word, pair, rank, low = (x[~over] for x in (ids, word, pair, rank, low))
                if not len(ids):
                    break
            hit = rank == low
            at = np.arange(len(ids))
            before = np.concatenate([[False], hit[:-1]])
            hit &= (at - np.maximum.accumulate(np.where(hit & ~before, at, 0))) % 2 == 0  # of pairs that overlap, every other one
            ids[hit] = self._joined[pair[hit]]
            keep = ~np.concatenate([[False], hit[:-1]])
            joined = hit[keep]
            ids, word, pair, rank = (x[keep] for x in (ids, word, pair, rank))
            new = np.flatnonzero(joined)
            again = np.unique(np.concatenate([new, new[new > 0] - 1]))
            rank[again] = none
            again = again[again + 1 < len(ids)]
            pair[again], rank[again] = look_up(again)
        return out


class Lexicon:
    """Minimal acyclic transducer: bytes of a word to its rank, and by that to its ids."""

    PARTS = (("keys", np.uint32), ("targets", np.uint32), ("outputs", np.uint32), ("final", np.uint8), ("starts", np.uint32), ("ids", np.uint32))

    def __init__(self, **parts: np.ndarray):
        self.__dict__.update(parts)

    @classmethod
    def compile(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        words = sorted(entries)
        register: dict[tuple, int] = {}
        nodes: list[tuple] = []  # frozen nodes: (final, ((label, node), ...))
        path: list[list] = [[False, []]]  # open nodes along the last word

        def freeze(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                key = (final, tuple(arcs))
                if (n := register.get(key)) is None:
                    n = register[key] = len(nodes)
                    nodes.append(key)
                arcs_above = path[-1][1]
                arcs_above[-1] = (arcs_above[-1][0], n)

        last = b""
        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            freeze(same)
            for b in word[same:]:
                path[-1][1].append((b, -1))
                path.append([False, []])
            path[-1][0] = True
            last = word
        freeze(0)
        nodes.append((path[0][0], tuple(path[0][1])))
        root = len(nodes) - 1
        number = lambda n: root - n  # noqa: E731  the root is state 0
        count = [0] * len(nodes)  # words from here on; arcs lead to nodes frozen earlier
        arcs = []
        for n, (final, out) in enumerate(nodes):
            total = int(final)
            for label, to in out:
                arcs.append((number(n) << 8 | label, number(to), total))
                total += count[to]
            count[n] = total
        arcs.sort()
        lens = np.array([len(entries[w]) for w in words], np.uint32)
        return cls(
            keys=np.array([a[0] for a in arcs], np.uint32), targets=np.array([a[1] for a in arcs], np.uint32), outputs=np.array([a[2] for a in arcs], np.uint32),
            final=np.array([nodes[root - s][0] for s in range(len(nodes))], np.uint8), starts=np.concatenate([[0], np.cumsum(lens)]).astype(np.uint32),
            ids=np.array([i for w in words for i in entries[w]], np.uint32),
        )

    def dump(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, n), t) for n, t in self.PARTS]
        blobs = [p.tobytes() + bytes(-p.nbytes % 8) for p in parts]
        return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(blobs)

    @classmethod
    def map(cls, path: str) -> Lexicon:
        """The arrays of a dumped lexicon, memory-mapped."""
        raw = np.memmap(path, np.uint8, "r")
        sizes, at, parts = raw[: 8 * len(cls.PARTS)].view(np.int64), 8 * len(cls.PARTS), {}
        for (name, kind), n in zip(cls.PARTS, sizes, strict=True):
            width = int(n) * np.dtype(kind).itemsize
            parts[name] = raw[at : at + width].view(kind)
            at += width + -width % 8
        return cls(**parts)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for words not in the lexicon; all words take each step together."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        if not len(self.keys) or not len(words):
            return np.full(len(words), -1)
        buf = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        at = np.cumsum(lens) - lens
        rank, state = np.zeros(len(words), np.int64), np.zeros(len(words), np.uint32)
        alive = np.arange(len(words))
        ended = []
        step = 0
        while len(alive):
            done = lens[alive] == step
            ended.append(alive[done])
            alive = alive[~done]
            key = state[alive] << np.uint32(8) | buf[at[alive] + step]
            pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[pos] == key
            alive, pos = alive[hit], pos[hit]
            state[alive] = self.targets[pos]
            rank[alive] += self.outputs[pos]
            step += 1
        out = np.full(len(words), -1)
        for e in ended:
            e = e[self.final[state[e]] == 1]
            out[e] = rank[e]
        return out


class Encoder:
    """Encodes texts with a lexicon and exact merges, and decodes ids."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, newer: str | None = None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        newer = newer_letters() if newer is None else newer
        self.newer = regex.compile(f"[{newer}]") if newer else None
        self.exact = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{newer}]]+| ?[\p{{N}}--[{newer}]]+| ?[[^\s\p{{L}}\p{{N}}]||[{newer}]]+|\s+(?!\S)|\s+") if newer else WORDS
        self.memo = IdMemo(self._encode_pieces)
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True)))) if vocabulary.added else None

    def _encode_pieces(self, pieces: list) -> list[list[int]]:
        """A piece is text after a blank, or a 1-tuple of text to be taken as it stands."""
        words_of = [self._words(" " + p if isinstance(p, str) else p[0]) for p in pieces]
        words: dict[str, int] = {}
        for ws in words_of:
            for w in ws:
                words.setdefault(w, len(words))
        raw = [w.encode() for w in words]
        starts, ids, ranks = self.lexicon.starts, self.lexicon.ids, self.lexicon.ranks(raw)
        merged = iter(self.vocabulary.merge_many([w for w, r in zip(raw, ranks.tolist(), strict=True) if r < 0]))
        found = [ids[starts[r] : starts[r + 1]].tolist() if r >= 0 else next(merged) for r in ranks.tolist()]
        return [found[words[ws[0]]] if len(ws) == 1 else [i for w in ws for i in found[words[w]]] for ws in words_of]

    def _words(self, text: str) -> list[str]:
        return (WORDS if text.isascii() or self.newer is None or not self.newer.search(text) else self.exact).findall(text)

    @staticmethod
    def _pieces(text: str) -> list:
        if ODD_BLANK.search(text):
            return [(p,) for p in BEFORE_WORD.split(text) if p]
        parts: list = text.split(" ")
        parts[0] = (parts[0],)
        return parts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts, owner = [], []
        for k, text in enumerate(texts):
            at = 0
            for m in self.special.finditer(text) if self.special and any(s in text for s in self.vocabulary.added) else ():
                parts += [text[at : m.start()], m[0]]
                owner += [k, k]
                at = m.end()
            parts.append(text[at:])
            owner.append(k)
        plain = self.memo.ids([self._pieces(p) if p not in self.vocabulary.added else [] for p in parts])
        if len(parts) == len(texts):
            return plain
        out: list[list] = [[] for _ in texts]
        for k, p, ids in zip(owner, parts, plain, strict=True):
            out[k].append(np.array([self.vocabulary.added[p]], np.uint32) if p in self.vocabulary.added else ids)
        return [np.concatenate(x) for x in out]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.vocabulary.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def vocabulary_lexicon(vocabulary: Vocabulary) -> Lexicon:
    """The tokenizer's own frequent words: each token of its vocabulary, with the ids its merges give."""
    return Lexicon.compile({b: vocabulary.merge(b) for b in vocabulary.token_bytes if b})


_encoders: dict[tuple, Encoder] = {}


def encoder(tokenizer: str, lexicon_path: str, newer: str) -> Encoder:
    """One encoder per worker, as its memo and the mapped lexicon serve all tasks."""
    key = (tokenizer, lexicon_path)
    if key not in _encoders:
        _encoders[key] = Encoder(Vocabulary(tokenizer), Lexicon.map(lexicon_path), newer)
    return _encoders[key]


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, and the SHA-256 of its ids and of the text decoded from them.

    tokenizer is a file of the driver; the executors get it along with the lexicon. A row without text
    counts as empty (no ids, the digest of nothing). A text of any length is encoded whole: beside its own
    ids it holds a slice, and of its pieces only the short ones are kept. Rows are independent: repeated
    rows and null keys go through as they are, there are no ties, an empty table gives no rows; other
    columns are not looked at.
    """
    file, newer = shipped_file(docs.sparkSession, tokenizer, "tokenizer"), newer_letters()
    ship = Ship(docs.sparkSession, vocabulary_lexicon(Vocabulary(tokenizer)).dump(), "bpe-lexicon")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        enc = encoder(file.path(), ship.path(), newer)
        for batch in slices(batches):
            ids = enc.encode(texts_of(batch))
            yield out_batch(schema, batch.column("doc_id"), [len(i) for i in ids], [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], [hashlib.sha256(enc.decode(i).encode()).hexdigest() for i in ids])

    return map_arrow(id_text(docs, id_col, text_col), run, SCHEMA)
