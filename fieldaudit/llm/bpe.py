"""Operator 9: byte-level BPE by speculation and verification.

Texts are cut into words in NumPy; a worker remembers words with their ids, finds them by hash and compares their bytes, and those it doesn't
know yet are encoded together: the longest token at each place is proposed for all words in lockstep, a word stands if every two neighbours are compatible, and only
the rest are merged exactly. Two tokens are compatible if no merge between a right edge of the first and a left edge of the second could have
come before the merges that swallow those edges; if all neighbours are compatible, merging the whole word gives the same tokens.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from fieldaudit.llm.common import keep
from fieldaudit.llm.hashing import SHORT, lanes, word_hashes

NEVER = np.int64(1) << np.int64(30)
#: Different words that a worker remembers; beyond it, it begins anew. And characters that are encoded at once.
KEEP, CHUNK = 400_000, 1 << 19
_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3
#: Where a word always ends: before white space that follows something else.
GAP = re.compile(r"(?<=[^\s\x85])\s")


@cache
def _kinds() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    kind = np.full(0x110000, _OTHER, np.uint8)
    first = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    kind[first == "L"], kind[first == "N"] = _LETTER, _NUMBER
    # Unicode's White_Space
    kind[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return kind


def _bounds(cp: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where words begin in the code points of several texts; edges: where texts begin.

    The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|white space not before a word|white space.
    """
    n = len(cp)
    kind = _kinds()[cp]
    space = kind == _SPACE
    edge = np.zeros(n + 1, bool)
    edge[edges] = edge[n] = True
    change = edge[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    # the last blank before a word goes with it; another white space there is a word alone; the white space before it is a word
    word = change & ~space
    word[0] = False
    at = np.flatnonzero(word & ~edge[:n])
    at = at[space[at - 1]]
    begin = change.copy()
    begin[at - 1] = True
    begin[at[cp[at - 1] == 32]] = False
    # contractions: a lone ' that nothing has taken, then one of their endings
    q = np.flatnonzero((cp == 39) & begin[:n])
    if len(q):
        pad = np.zeros(3, cp.dtype)
        c = np.concatenate([cp, pad])
        e = np.concatenate([edge, [True] * 3])
        a, b = c[q + 1], c[q + 2]
        one = ~e[q + 1] & np.isin(a, [ord(x) for x in "stmd"])
        two = ~e[q + 1] & ~e[q + 2] & np.logical_or.reduce([(a == ord(x)) & (b == ord(y)) for x, y in ("re", "ve", "ll")])
        size = np.where(one, 2, np.where(two, 3, 0))
        for p, k in zip(q[size > 0], size[size > 0]):
            begin[p + 1 : p + k] = False
            if p + k < n and not e[p + k] and kind[p + k] == _LETTER:
                begin[p + k] = True
    return np.flatnonzero(begin)


class Encoder:
    """encode(texts) for the byte-level BPE in a tokenizer file; its added tokens' strings count as those tokens, as the file's library has it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # The printable stand-ins for bytes in such files
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        raw = lambda t: bytes(stand[c] for c in t)
        vocab = spec["model"]["vocab"]
        self.bytes: dict[int, bytes] = {i: raw(t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.bytes, *self.special.values()]) + 1
        self.byte_id = np.array([vocab[c] for c, _ in sorted(stand.items(), key=lambda x: x[1])])
        self.made = np.full(size, -1, np.int64)  # rank of the merge that makes a token
        left, right = np.full(size, -1), np.full(size, -1)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merges[x, y] = (rank, z)
            if self.made[z] < 0:
                self.made[z], left[z], right[z] = rank, x, y
        keys = np.array([(a << 32) | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair, self.rank = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.product = np.array([z for _, z in self.merges.values()], np.int64)
        self.size = size
        self.byte_rank = self._ranks(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256)).reshape(256, 256)
        self.left_edge, self.left_end = self._edges(left)
        self.right_edge, self.right_end = self._edges(right)
        self.sound = np.array([i in self.bytes and (len(self.bytes[i]) == 1 or self.made[i] >= 0) for i in range(size)])
        self._trie()
        self.cut_out = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.raw = [self.bytes.get(i, b"") for i in range(size)]
        for t, i in self.special.items():
            self.raw[i] = t.encode()
        self.names = [str(i) for i in range(size)]
        self._forget()

    def _edges(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's outermost parts, itself first, and the rank at which each is swallowed by the one before; -1 and 0 pad."""
        rows = [np.arange(self.size)]
        while (below := np.where(rows[-1] >= 0, part[rows[-1]], -1)).max() >= 0:
            rows.append(below)
        edge = np.stack(rows, 1)
        end = np.full(edge.shape, NEVER)
        end[:, 1:] = self.made[edge[:, :-1]]
        end[edge < 0] = -2
        return edge.astype(np.int32), end.astype(np.int32)

    def _trie(self) -> None:
        """Children of each node by byte, as one sorted column of node and byte, and the token that ends at each node."""
        node: dict[bytes, int] = {b"": 0}
        for t in self.bytes.values():
            for k in range(1, len(t) + 1):
                node.setdefault(t[:k], len(node))
        self.token = np.full(len(node), -1, np.int32)
        key = np.array([node[t[:-1]] * 256 + t[-1] for t in node if t], np.int64)
        order = np.argsort(key)
        self.branch, self.child = key[order], np.arange(1, len(node), dtype=np.int32)[order]
        for i, t in self.bytes.items():
            if self.sound[i]:
                self.token[node[t]] = i

    def _exact(self, word: bytes) -> list[int]:
        """Merges by rank, leftmost first, with a heap over a linked list: n log n for a word of n bytes."""
        ids: list[int] = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (m := self.merges.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.merges[a, b][1], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (m := self.merges.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each a and b, or NEVER."""
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (a >= 0) & (b >= 0), self.rank[at], NEVER)

    def _exact_all(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """_exact() for many words: in each round, every word makes its first merge of lowest rank. Words of over 64 bytes go one by one."""
        out: list[np.ndarray] = [None] * len(starts)  # type: ignore[list-item]
        size = ends - starts
        for k in np.flatnonzero(size > 64):
            out[k] = np.array(self._exact(data[starts[k] : ends[k]].tobytes()), np.int64)
        for low, high in ((0, 8), (8, 12), (12, 20), (20, 64)):
            of = np.flatnonzero((size > low) & (size <= high))
            if not of.size:
                continue
            place = starts[of][:, None] + np.arange(high)
            there = place < ends[of][:, None]
            ids = np.where(there, self.byte_id[data[np.minimum(place, len(data) - 1)]], -1)
            rank = np.full(ids.shape, NEVER)
            rank[:, :-1] = np.where(there[:, 1:], self.byte_rank[data[np.minimum(place[:, :-1], len(data) - 1)], data[np.minimum(place[:, 1:], len(data) - 1)]], NEVER)
            after = np.tile(np.arange(1, high + 1), (len(of), 1))
            before = np.tile(np.arange(-1, high - 1), (len(of), 1))
            row = np.arange(len(of))
            while row.size:
                i = rank[row].argmin(1)
                go = rank[row, i] < NEVER
                row, i = row[go], i[go]
                j = after[row, i]
                z = self.product[rank[row, i]]
                ids[row, i], ids[row, j], rank[row, j] = z, -1, NEVER
                k = after[row, j]
                after[row, i] = k
                inner = k < high
                before[row[inner], k[inner]] = i[inner]
                rank[row, i] = np.where(inner, self._ranks(z, ids[row, np.minimum(k, high - 1)]), NEVER)
                h = before[row, i]
                outer = h >= 0
                rank[row[outer], h[outer]] = self._ranks(ids[row[outer], h[outer]], z[outer])
            for k, x in zip(of, ids):
                out[k] = x[x >= 0]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a and b together gives a and b again, for each pair."""
        ok = np.ones(len(a), bool)
        for i in range(self.right_edge.shape[1]):
            x, x_end = self.right_edge[a, i], self.right_end[a, i]
            if not (live := np.flatnonzero(ok & (x >= 0))).size:
                break
            for j in range(self.left_edge.shape[1]):
                k = live[(self.left_edge[b[live], j] >= 0)]
                if not k.size:
                    break
                y, y_end = self.left_edge[b[k], j], self.left_end[b[k], j]
                rank = self._ranks(x[k], y)
                together = np.maximum(self.made[x[k]], self.made[y]) < np.minimum(x_end[k], y_end)
                ok[k[(rank < x_end[k]) & (rank <= y_end) & (rank < NEVER) & together]] = False
        return ok

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words data[starts:ends], one after another, and where each word's begin."""
        n = len(starts)
        if not n:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        at, node, best, best_at = starts.copy(), np.zeros(n, np.int64), np.full(n, -1, np.int64), starts.copy()
        live = np.arange(n)
        out_word, out_id = [], []
        while live.size:  # one byte of every word at a time
            p = at[live]
            inside = p < ends[live]
            key = node[live] * 256 + data[np.minimum(p, len(data) - 1)]
            found = np.minimum(np.searchsorted(self.branch, key), len(self.branch) - 1)
            step = np.where(inside & (self.branch[found] == key), self.child[found], -1)
            go = step >= 0
            moved = live[go]
            node[moved] = step[go]
            at[moved] += 1
            token = self.token[step[go]]
            hit = moved[token >= 0]
            best[hit], best_at[hit] = token[token >= 0], at[hit]
            stuck = live[~go]
            out_word.append(stuck)
            out_id.append(best[stuck])
            at[stuck], node[stuck] = best_at[stuck], 0
            live = np.concatenate([moved, stuck[best_at[stuck] < ends[stuck]]])
            best[stuck] = -1
        word, ids = np.concatenate(out_word), np.concatenate(out_id)
        order = np.argsort(word, kind="stable")
        word, ids = word[order], ids[order]
        first = np.searchsorted(word, np.arange(n + 1))
        same = np.flatnonzero(word[1:] == word[:-1])
        ok = np.ones(n, bool)
        if same.size:
            pairs, back = np.unique((ids[same] << 32) | ids[same + 1], return_inverse=True)
            fine = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
            ok[word[same[~fine]]] = False
        if not ok.all():
            bad = np.flatnonzero(~ok)
            parts = self._exact_all(data, starts[bad], ends[bad])
            count = np.diff(first)
            count[bad] = [len(p) for p in parts]
            keep = ids[np.repeat(ok, np.diff(first))]
            first = np.concatenate([[0], np.cumsum(count)])
            mended = np.repeat(~ok, count)
            ids = np.empty(first[-1], np.int64)
            ids[mended], ids[~mended] = np.concatenate(parts), keep
        return ids.astype(np.int32), first

    def _forget(self) -> None:
        """No words known: hashes, sorted, and numbers of words; their ids and their bytes, one after another, and where each word's begin."""
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.spelled, self.spelled_at = np.zeros(8, np.uint8), np.zeros(1, np.int64)

    def _slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of words, new ones made known; -1 where another word of that hash is known, which never hides behind it."""
        different, where, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) + len(different) > KEEP:
            self._forget()
        place = np.searchsorted(self.known, different)
        slot = np.full(len(different), -1, np.int64)
        if len(self.known):
            near = np.minimum(place, len(self.known) - 1)
            slot = np.where(self.known[near] == different, self.slot[near], -1)
        if (new := np.flatnonzero(slot < 0)).size:
            b, e = starts[where[new]], ends[where[new]]
            ids, first = self.words(data, b, e)
            slot[new] = np.arange(len(self.at) - 1, len(self.at) - 1 + len(new))
            self.known, self.slot = np.insert(self.known, place[new], different[new]), np.insert(self.slot, place[new], slot[new])
            self.at = np.concatenate([self.at, self.at[-1] + first[1:]])
            self.flat = np.concatenate([self.flat, ids])
            ends_at = np.cumsum(e - b)
            text = data[np.repeat(b - (ends_at - (e - b)), e - b) + np.arange(ends_at[-1])]
            self.spelled_at = np.concatenate([self.spelled_at, self.spelled_at[-1] + ends_at])
            self.spelled = np.concatenate([self.spelled[:-8], text, np.zeros(8, np.uint8)])
        slot = slot[back]
        return np.where(self._spelled_so(slot, data, starts, ends), slot, -1)

    def _spelled_so(self, slot: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the known words are the words data[starts:ends], by their bytes."""
        size, at = ends - starts, self.spelled_at[slot]
        same = self.spelled_at[slot + 1] - at == size
        mine = np.concatenate([data, np.zeros(8, np.uint8)])
        live = np.flatnonzero(same & (size <= SHORT))
        for k in range(SHORT // 8):
            if not live.size:
                break
            same[live] = lanes(mine, starts[live] + 8 * k, size[live] - 8 * k) == lanes(self.spelled, at[live] + 8 * k, size[live] - 8 * k)
            live = live[same[live] & (size[live] > 8 * k + 8)]
        for i in np.flatnonzero(same & (size > SHORT)).tolist():
            same[i] = np.array_equal(data[starts[i] : ends[i]], self.spelled[at[i] : at[i] + size[i]])
        return same

    def _plain(self, text: str, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of several texts joined, none with an added token in it; edges: where each begins. Also where each text's ids begin."""
        if not text:
            return np.zeros(0, np.int32), np.zeros(len(edges) + 1, np.int64)
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(cp)
        begin = _bounds(cp, edges[edges < n])
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        byte_at = np.arange(n + 1) if len(data) == n else np.concatenate([[0], np.cumsum(1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF))])
        starts, ends = byte_at[begin], byte_at[np.append(begin[1:], n)]
        use = self._slots(data, starts, ends)
        flat, at = self.flat, self.at
        if (lost := np.flatnonzero(use < 0)).size:
            own = [np.array(self._exact(data[starts[i] : ends[i]].tobytes()), np.int32) for i in lost]
            use[lost] = np.arange(len(at) - 1, len(at) - 1 + len(lost))
            flat, at = np.concatenate([flat, *own]), np.concatenate([at, at[-1] + np.cumsum([len(x) for x in own])])
        count = at[use + 1] - at[use]
        stop = np.cumsum(count)
        ids = flat[np.repeat(at[use] - (stop - count), count) + np.arange(stop[-1])]
        word = np.searchsorted(begin, np.append(edges, n))
        return ids, np.concatenate([[0], stop])[word]

    def parts(self, texts: pa.Array) -> Iterator[tuple[int, bool, np.ndarray]]:
        """(number of the text, whether it ends here, ids): the texts' ids in order, a very long text in several parts. A null text is empty."""
        group: list[tuple[int, bool, str]] = []
        held = 0

        def flush() -> Iterator[tuple[int, bool, np.ndarray]]:
            nonlocal held
            edges = np.concatenate([[0], np.cumsum([len(t) for _, _, t in group])]).astype(np.int64)[:-1]
            ids, at = self._plain("".join(t for _, _, t in group), edges)
            for i, (k, last, _) in enumerate(group):
                yield k, last, ids[at[i] : at[i + 1]]
            group.clear()
            held = 0

        for k, text in enumerate(texts.to_pylist()):
            text, at = text or "", 0
            if self.cut_out and self.cut_out.search(text):
                yield from flush()
                found = [np.array([self.special[t]], np.int32) if t in self.special else self._plain(t, np.zeros(1, np.int64))[0] for t in self.cut_out.split(text)]
                yield k, True, np.concatenate(found)
                continue
            while len(text) - at > CHUNK and (gap := GAP.search(text, at + CHUNK)):
                group.append((k, False, text[at : gap.start()]))
                at = gap.start()
                yield from flush()
            group.append((k, True, text[at:]))
            held += len(text) - at
            if held >= CHUNK:
                yield from flush()
        yield from flush()

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; a null text is empty."""
        before: list[np.ndarray] = []
        for _, last, ids in self.parts(texts):
            before.append(ids)
            if last:
                yield before[0] if len(before) == 1 else np.concatenate(before)
                before = []

    def digests(self, texts: pa.Array) -> tuple[list[int], list[str], list[str]]:
        """Of each text: how many ids, the SHA-256 of them as decimals joined by commas, and that of the text that they decode to."""
        counts, named, decoded = [], [], []
        for k, last, ids in self.parts(texts):
            if k == len(counts):
                counts.append(0)
                named.append(hashlib.sha256())
                decoded.append(hashlib.sha256())
            if len(ids):
                named[k].update(("," * (counts[k] > 0) + ",".join(map(self.names.__getitem__, ids.tolist()))).encode())
                decoded[k].update(self.decode(ids).encode())  # parts end between characters
            counts[k] += len(ids)
        return counts, [h.hexdigest() for h in named], [h.hexdigest() for h in decoded]

    def decode(self, ids: np.ndarray) -> str:
        """Bytes of the tokens joined, as UTF-8 with bad parts replaced; an added token stands for its string."""
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encoder(path: str) -> Encoder:
    """One encoder for each worker and file, as long as the worker serves no other operator."""
    return keep(f"encoder {path}", lambda: Encoder(path))


def vocabulary(path: str = "") -> str:
    """The tokenizer file; by default the public 50k byte-level BPE, looked up where the code runs."""
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.json")


def encode(docs, path: str = "", digest: bool = True):
    """doc_id and per document: ids array<int> (digest=False), or n_tokens, ids_sha256, decoded_sha256 (digest=True).

    The ids of the whole text by the tokenizer file at path, nothing added, cut or padded; a null text is empty: no ids, the digest of an
    empty string. Rows are encoded alone: no shuffle; repeated rows and clashing extra columns (they aren't read) change nothing.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>"

    def run(batches):
        coder = encoder(vocabulary(path))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                if digest:
                    counts, named, decoded = coder.digests(part.column("text"))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(named, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    found = list(coder.encode(part.column("text")))
                    at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(at, pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))], ["doc_id", "ids"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(run, schema)


def query(spark, sf_dir: str):
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
