"""Tokenising with a cache of chunks: each worker encodes a distinct chunk once.

A chunk begins at a white-space byte that a visible character follows. Neither the
byte-level nor the word-end vocabulary ever merges across such a place, so the ids
of a text are the ids of its chunks one after the other. Chunks are looked up by a
64-bit hash and checked by a second one."""

from __future__ import annotations

import os

import numpy as np

from ledgerloom.llm.kernels import SPACE, Texts, bounds, gather, held, range_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: chunks a worker keeps; one takes 28 bytes and its ids 4 each
CACHE_CHUNKS = 800_000
_JOIN = 64
#: first bytes of the characters outside ASCII that include white space
_UNSURE = np.zeros(256, bool)
_UNSURE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """``encode(Texts)`` gives all ids and where each text's ids begin."""

    def __init__(self, limit: int = CACHE_CHUNKS):
        self.limit, self.tiers, self.ids, self.used = limit, [], np.zeros(1 << 20, np.uint32), 0

    def encode_strings(self, strings: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def _starts(self, texts: Texts) -> np.ndarray:
        data = texts.data
        begins = np.zeros(len(data) + 1, bool)
        space = SPACE[data]
        begins[: len(data) - 1] = space[:-1] & ~space[1:] & ~_UNSURE[data[1:]]
        begins[texts.offsets[1:][texts.offsets[1:] > 0] - 1] = False
        begins[texts.offsets[:-1]] = True
        return np.flatnonzero(begins[: len(data)])

    def _find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, count = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
        for keys, checks, where, counts in self.tiers:
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = (keys[i] == key) & (checks[i] == check)
            at[hit], count[hit] = where[i[hit]], counts[i[hit]]
        return at, count

    def _add(self, key: np.ndarray, check: np.ndarray, ids: list[np.ndarray] | tuple[np.ndarray, np.ndarray]) -> None:
        flat, counts = ids
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
        self.ids[self.used:self.used + len(flat)] = flat
        tier = (key, check, self.used + bounds(counts)[:-1], counts.astype(np.int32))
        self.used += len(flat)
        while self.tiers and len(self.tiers[-1][0]) <= 2 * len(tier[0]):
            both = [np.concatenate(x) for x in zip(self.tiers.pop(), tier, strict=True)]
            order = np.argsort(both[0], kind="stable")
            tier = tuple(x[order] for x in both)
        self.tiers.append(tier)

    def _encode_chunks(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = self.encode_strings(strings)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for x in lists for i in x), np.uint32, counts.sum()), counts

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        starts = self._starts(texts)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        ends = np.append(starts[1:], len(texts.data))
        key, check = range_hashes(texts.data, starts, ends, 0), range_hashes(texts.data, starts, ends, 1)
        unique, index, inverse = np.unique(key, return_index=True, return_inverse=True)
        if not np.array_equal(check[index][inverse], check):  # two chunks of one hash: no cache here
            flat, counts = self._encode_chunks([texts.raw(i).decode() for i in range(len(texts))])
            return flat, bounds(counts)
        if sum(len(t[0]) for t in self.tiers) > self.limit:
            self.tiers, self.used = [], 0
        at, count = self._find(unique, check[index])
        if len(new := np.flatnonzero(at < 0)):
            body = texts.data.tobytes()
            strings = [body[a:b].decode() for a, b in zip(starts[index[new]].tolist(), ends[index[new]].tolist(), strict=True)]
            begin, (flat, counts) = self.used, self._encode_chunks(strings)
            self._add(unique[new], check[index[new]], (flat, counts))
            at[new], count[new] = begin + bounds(counts)[:-1], counts
        counts = count[inverse]
        ids = self.ids[gather(at[inverse], counts)]
        return ids, bounds(counts)[np.searchsorted(starts, texts.offsets)]


class Bpe(ChunkEncoder):
    """A vocabulary file of the tokenizers library. Missing chunks are encoded many
    to a string, and the ids dealt back by the bytes each id stands for."""

    def __init__(self, path: str, limit: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        super().__init__(limit)
        self.tokenizer = Tokenizer.from_file(path)
        #: first two bytes of the markers that the library finds in a text before it splits it into words
        self.markers = {t.content.encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token.removesuffix("</w>")) if len(token) > 4 else len(token)
        self.word_ends = any(t.endswith("</w>") and len(t) > 4 for t in list(vocabulary)[:2000])

    def _starts(self, texts: Texts) -> np.ndarray:
        """No chunk begins before a marker: white space in front of one ends a piece."""
        starts, data = super()._starts(texts), texts.data
        inner = starts[(starts + 2 < len(data)) & ~np.isin(starts, texts.offsets)]
        marked = np.zeros(len(inner), bool)
        for marker in self.markers:
            marked |= (data[inner + 1] == marker[0]) & (data[inner + 2] == marker[-1])
        return np.setdiff1d(starts, inner[marked], assume_unique=True) if marked.any() else starts

    def encode_strings(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _encode_chunks(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.word_ends:
            plain = [s.strip("\t\n\v\f\r ").lower() for s in strings]
            sizes = np.fromiter((len(s.encode()) for s in plain), np.int64, len(plain))
        else:
            sizes = np.fromiter((len(s.encode()) for s in strings), np.int64, len(strings))
        safe = sizes < 200
        if self.word_ends:
            safe &= np.fromiter(map(str.isascii, strings), bool, len(strings)) | np.fromiter(
                (s[:1] in "\t\n\v\f\r " for s in strings), bool, len(strings))
        counts, lists, order = np.zeros(len(strings), np.int64), [], []
        chosen = np.flatnonzero(safe)
        groups = [chosen[i:i + _JOIN] for i in range(0, len(chosen), _JOIN)]
        glue = " ".join if self.word_ends else "".join
        odd = [np.flatnonzero(~safe)]
        if not self.word_ends:  # only a chunk that begins with white space may follow another
            loose = np.fromiter((s[:1] not in "\t\n\v\f\r " for s in strings), bool, len(strings)) & safe
            odd.append(np.flatnonzero(loose))
            chosen = np.flatnonzero(safe & ~loose)
            groups = [chosen[i:i + _JOIN] for i in range(0, len(chosen), _JOIN)]
        joined = self.encode_strings([glue([strings[i] for i in g.tolist()]) for g in groups])
        for g, ids in zip(groups, joined, strict=True):
            ids = np.asarray(ids, np.int64)
            reach = np.concatenate(([0], np.cumsum(self.lengths[ids])))
            want = np.cumsum(sizes[g])
            cut = np.searchsorted(reach, want)
            if len(ids) and reach[-1] == want[-1] and np.array_equal(reach[cut], want):
                counts[g] = np.diff(cut, prepend=0)
                lists.append(ids)
                order.append(g)
            else:
                odd.append(g)
        rest = np.concatenate(odd)
        if len(rest):
            single = self.encode_strings([strings[i] for i in rest.tolist()])
            counts[rest] = [len(x) for x in single]
            lists.append(np.fromiter((i for x in single for i in x), np.int64, counts[rest].sum()))
            order.append(rest)
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        order = np.concatenate(order) if order else np.zeros(0, np.int64)
        at = np.zeros(len(strings), np.int64)
        at[order] = bounds(counts[order])[:-1]
        return flat[gather(at, counts)].astype(np.uint32), counts


class Pieces(ChunkEncoder):
    """A sentencepiece model; a chunk is encoded as a word by itself."""

    def __init__(self, path: str, limit: int = CACHE_CHUNKS):
        import sentencepiece

        super().__init__(limit)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.is_byte = np.fromiter((self.model.is_byte(i) for i in range(size)), bool, size)

    def encode_strings(self, strings: list[str]) -> list[list[int]]:
        return self.model.encode([s.strip("\t\n\v\f\r ") for s in strings], num_threads=1)


def bpe(path: str) -> Bpe:
    return held((Bpe, path), lambda: Bpe(path))


def sentence_pieces(path: str) -> Pieces:
    return held((Pieces, path), lambda: Pieces(path))
