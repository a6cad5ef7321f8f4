"""Held-out passages in a training corpus: which documents hold them, which items leaked, and the texts without them.

The passages' word n-grams are hashed into a sorted set that every executor gets; a large test set comes in blocks of
bounded size. A corpus is read once, whatever the number of blocks: the words of a group of documents are hashed once, all
windows of n words are made as arrays, and the blocks are looked up in turn, one in memory at a time. A hit is verified by
extending it to both sides with a bounded number of altered, left-out and put-in words. Leaked spans are cut in the same scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame

from gaugeflow.functions.columns import need
from gaugeflow.llm.confusables import Confusables, confusables

#: Rule: a leak is LEAST_WORDS words of the passage in order, at most one in EDIT_ONE_IN of them altered.
LEAST_WORDS = 16
EDIT_ONE_IN = 8
#: Any such stretch keeps 5 words in a row, at two places or more: of 16 words with 2 edits, 14 are kept in at most 3
#: pieces, which hold 14 - 3 x 4 = 2 runs of 5 at least; longer stretches keep more.
SEED_WORDS = 5
LEAST_SEEDS = 2
#: Characters of passages in one block; its n-gram hashes take about as many bytes.
BLOCK_CHARS = 8_000_000
#: Characters of documents that one block is looked up for at a time, where there is more than one block.
GROUP_CHARS = 32_000_000

_NO_WORD = re.compile(r"[^\w\s]|_")
_TOKEN = re.compile(r"\S+")
#: Letters of scripts written without blanks between words (Thai, Lao, Myanmar, Khmer, kana, Han); each is a word.
_UNSPACED = re.compile("([\u0e01-\u0e30\u0e32\u0e33\u0e40-\u0e46\u0e81-\u0eb0\u0eb2\u0eb3\u0ec0-\u0ec6\u1000-\u102a\u1780-\u17b3\u3005-\u3007\u3041-\u3096\u30a1-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af])")


def words_of(text: str, forms: Confusables) -> list[str]:
    """Words as they count: in consistent characters, without case and punctuation, with a letter or digit. A letter of a
    script that is written without blanks is a word of its own."""
    plain = _NO_WORD.sub("", forms.consistent(text, whole="Latn").casefold())
    if not plain.isascii():
        plain = _UNSPACED.sub(r" \1 ", plain)
    return plain.split()


def word_spans(text: str, forms: Confusables) -> list[tuple[str, int, int]]:
    """(word, start, end) of each word in the text as it stands; words of one blank-free stretch of letters that are
    words of their own share it, as far as they can't be told apart by place."""
    out = []
    for m in _TOKEN.finditer(text):
        words = words_of(m[0], forms)
        if len(words) == 1:
            out.append((words[0], m.start(), m.end()))
        elif words:
            out += _placed(words, m[0], m.start(), forms)
    return out


def _placed(words: list[str], token: str, start: int, forms: Confusables) -> list[tuple[str, int, int]]:
    """Places of several words of a token without blanks: letter by letter, each letter with what it is written with."""
    cuts, have = [0], 0
    for i in range(1, len(token) + 1):
        n = len(words_of(token[:i], forms))
        if n > have:  # the word n begins with the letter before i
            cuts += [i - 1] * (n - have)
            have = n
    starts = cuts[1:]
    if len(starts) != len(words):  # letters that combine across places: the whole token stands for each
        return [(w, start, start + len(token)) for w in words]
    return [(w, start + a, start + z) for w, a, z in zip(words, starts, [*starts[1:], len(token)])]


def _reach(p: list[int], d: list[int], most: int) -> list[tuple[int, int, int]]:
    """Of 0, 1, ... most edits: (words, words of p, words of d). words: of the longest start of p that d starts with, by
    so many edits at most; the others: of the longest such start whose last word is kept. Furthest-reaching points by
    diagonal; an edit alters, leaves out or puts in a word."""
    np_, nd = len(p), len(d)
    i = 0
    while i < np_ and i < nd and p[i] == d[i]:
        i += 1
    front = {0: i}  # diagonal (place in d less place in p) to place in p
    kept = (i, i)
    out = [(i, i, i)]
    for _ in range(most):
        new = dict(front)
        for k, i in front.items():
            if i < np_:
                if i + k < nd and i + 1 > new[k]:  # altered
                    new[k] = i + 1
                if i + 1 > new.get(k - 1, -1):  # left out
                    new[k - 1] = i + 1
            if i + k < nd and i > new.get(k + 1, -1):  # put in
                new[k + 1] = i
        for k, i in new.items():
            n = i
            while n < np_ and n + k < nd and p[n] == d[n + k]:
                n += 1
            new[k] = n
            # where two words are alike, a path of as few edits ends in them (Ukkonen), however this point was come to
            while n > kept[0] and not (n + k > 0 and p[n - 1] == d[n + k - 1]):
                n -= 1
            if n > kept[0]:
                kept = (n, n + k)
        front = new
        out.append((max(front.values()), *kept))
    return out


def leaked_stretch(p: list[int], d: list[int], i: int, j: int, least: int = LEAST_WORDS, one_in: int = EDIT_ONE_IN) -> tuple[int, int, int, int] | None:
    """(words of p, edits, first and end word of d) of the longest stretch around the seed at p[i], d[j] that is long
    enough and altered little enough; None if there is none.

    Of two halves of a stretch that is altered little enough, one is so too. Hence each has a part of fewer than twice
    `least` words with its own seed, which is looked for first, with few edits; only where it is there, the whole is.
    """
    n = SEED_WORDS
    if p[i : i + n] != d[j : j + n]:
        return None

    def sides(most: int, room: int) -> tuple[list, list]:
        a, b = max(0, i - room), max(0, j - room - most)
        return _reach(p[a:i][::-1], d[b:j][::-1], most), _reach(p[i + n : i + n + room], d[j + n : j + n + room + most], most)

    few = (2 * least - 1) // one_in
    left, right = sides(few, 2 * least)
    if not any(n + left[a][0] + right[b][0] >= max(least, one_in * (a + b)) for a in range(few + 1) for b in range(few + 1 - a)):
        return None
    left, right = sides(len(p) // one_in, len(p))
    best = None
    for a, (_, lp, ld) in enumerate(left):
        for b, (_, rp, rd) in enumerate(right):
            length = n + lp + rp
            if length >= max(least, one_in * (a + b)) and (best is None or (length, -a - b) > (best[0], -best[1])):
                best = (length, a + b, j - ld, j + n + rd)
    return best


_MIX = np.random.default_rng(20240229).integers(1, 1 << 62, SEED_WORDS, dtype="uint64") * np.uint64(2) + np.uint64(1)


def _window_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of each SEED_WORDS words in a row, of hashes of words."""
    n = len(words) - SEED_WORDS + 1
    if n < 1:
        return np.array([], "uint64")
    h = np.zeros(n, "uint64")
    for k in range(SEED_WORDS):
        h = (h ^ words[k : k + n]) * _MIX[k]
        h ^= h >> np.uint64(29)
    return h


class WordHashes:
    """64-bit hashes of words, those of common words kept (most: when it is full, it starts anew)."""

    def __init__(self, most: int = 1 << 18):
        self.most, self.known = most, {}

    def __call__(self, words: list[str]) -> list[int]:
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return out


class PassageIndex:
    """N-grams of passages, for scanning: sorted n-gram hashes, where each occurs, and the passages' words."""

    def __init__(self, passages: list[list[str]]):
        hashed = WordHashes()
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for p in passages for w in p))}
        self.lists = [[self.vocabulary[w] for w in p] for p in passages]
        grams = [_window_hashes(np.array(hashed(p), "uint64")) for p in passages]
        h = np.concatenate(grams) if grams else np.array([], "uint64")
        order = np.argsort(h, kind="stable")
        self.which = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order].astype("int32")
        self.at = np.concatenate([np.arange(len(g)) for g in grams] or [np.array([], int)])[order].astype("int32")
        self.grams, first = np.unique(h[order], return_index=True)
        self.first = np.r_[first, len(h)]

    def seeds(self, windows: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(text, passage, words of the passage, words of the text) of the n-grams found, in the text's order. windows: of all texts one after the other, each followed by a word of none; begins:
        where each text does. Passages of fewer than LEAST_SEEDS hits in a text can't be in it and are left out."""
        if not len(windows) or not len(self.grams):
            return
        at = np.minimum(np.searchsorted(self.grams, windows), len(self.grams) - 1)
        hits = np.flatnonzero(self.grams[at] == windows)
        if not len(hits):
            return
        g = at[hits]
        often = self.first[g + 1] - self.first[g]
        rest = np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often)
        places = np.repeat(self.first[g], often) + rest
        place = np.repeat(hits, often)
        text = np.searchsorted(begins, place, side="right") - 1
        k, i, j = self.which[places].astype("int64"), self.at[places].astype("int64"), place - begins[text]
        order = np.lexsort((i, j, k, text))
        text, k, i, j = text[order], k[order], i[order], j[order]
        pair = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (k[1:] != k[:-1])])
        for a, z in zip(pair, np.r_[pair[1:], len(k)]):
            if z - a >= LEAST_SEEDS:
                yield int(text[a]), int(k[a]), i[a:z], j[a:z]

    def leaks(self, texts: list[list[str]], windows: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, passage, words, edits, first word, end word) of every leak, overlapping ones of a passage once."""
        get, now, numbers = self.vocabulary.get, -1, []
        for t, k, at_p, at_d in self.seeds(windows, begins):
            if t != now:
                now, numbers = t, [get(w, -1) for w in texts[t]]
            done = -1
            for i, j in zip(at_p.tolist(), at_d.tolist()):
                if j >= done and (best := leaked_stretch(self.lists[k], numbers, i, j)):
                    done = best[3]
                    yield (t, k, *best)


def windows_of(texts: list[list[str]], hashed: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(windows, begins) of the words of texts, as PassageIndex.seeds takes them."""
    flat: list[int] = []
    begins = []
    for t in texts:
        begins.append(len(flat))
        flat += hashed(t)
        flat.append(0)
    return _window_hashes(np.array(flat, "uint64")), np.array(begins, "int64")


def passage_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[PassageIndex, list[list[int]]]]:
    """Index and the items of each of its passages, block by block of at most block_chars characters."""
    forms = confusables(items.sparkSession)
    rows = need(items, "item_id", "passage").filter("item_id IS NOT NULL AND passage IS NOT NULL").orderBy("item_id")
    by_words: dict[tuple[str, ...], list[int]] = {}
    size = 0

    def block() -> tuple[PassageIndex, list[list[int]]]:
        return PassageIndex([list(p) for p in by_words]), list(by_words.values())

    for r in rows.toLocalIterator(prefetchPartitions=True):
        w = tuple(words_of(r["passage"], forms))
        if len(w) < LEAST_WORDS:
            continue
        if size + len(r["passage"]) > block_chars and by_words:
            yield block()
            by_words, size = {}, 0
        size += len(r["passage"])
        by_words.setdefault(w, []).append(r["item_id"])
    if by_words:
        yield block()


class _Blocks:
    """The blocks of passages as broadcasts: a single one stays in memory, of several one at a time is read."""

    def __init__(self, items: DataFrame, block_chars: int):
        sc = items.sparkSession.sparkContext
        self.shared = [sc.broadcast(b) for b in passage_blocks(items, block_chars)]

    def __iter__(self) -> Iterator[tuple[PassageIndex, list[list[int]]]]:
        for b in self.shared:
            yield b.value if len(self.shared) == 1 or not getattr(b, "_path", None) else Broadcast(path=b._path).value


def _grouped(frames: Iterator[pd.DataFrame], chars: int) -> Iterator[pd.DataFrame]:
    """Frames put together until they have so many characters."""
    held, size = [], 0
    for f in frames:
        held.append(f)
        size += int(f["text"].str.len().sum())
        if size >= chars:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _scanned(frame: pd.DataFrame, blocks: _Blocks, forms: Confusables, hashed: WordHashes) -> list[tuple]:
    """(place in the frame, item, words, edits, first word, end word) of every leak in the frame's texts."""
    texts = [words_of(t, forms) if isinstance(t, str) else [] for t in frame["text"]]
    windows, begins = windows_of(texts, hashed)
    return [(t, item, *what) for index, owners in blocks for t, k, *what in index.leaks(texts, windows, begins) for item in owners[k]]


LEAKS = "doc_id bigint, item_id bigint, words int, edits int, first_word int, end_word int"


def leaked_passages(documents: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS, group_chars: int = GROUP_CHARS) -> DataFrame:
    """(doc_id, item_id, words, edits, first_word, end_word): every stretch of an item's passage in a document.

    A stretch is at least LEAST_WORDS words of the passage, in order, starting and ending with a kept word, at most one
    in EDIT_ONE_IN altered, left out or put in. words and edits count them, first_word and end_word are places in the
    document. Case, punctuation, blanks, line breaks and look-alike characters don't count. Items of one passage are
    all reported; a passage of fewer words can't leak. Rows without id or text are left out.

    Documents are read once, where they lie, and never shuffled; a text is scanned whole.
    """
    blocks, forms = _Blocks(items, block_chars), confusables(documents.sparkSession)
    d = need(documents, "doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    several = len(blocks.shared) > 1

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = WordHashes()
        for frame in _grouped(frames, group_chars) if several else frames:
            ids = frame["doc_id"].tolist()
            rows = [(ids[t], *what) for t, *what in _scanned(frame, blocks, forms, hashed)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words", "edits", "first_word", "end_word"])

    return d.mapInPandas(scan, LEAKS)


def _cut(text: str, stretches: list[tuple[int, int]], forms: Confusables) -> str:
    """text without the stretches of words (first, end), which may overlap."""
    places = word_spans(text, forms)
    out, at = [], 0
    for first, end in sorted(stretches):
        if places[first:end]:
            a, z = places[first][1], places[min(end, len(places)) - 1][2]
            out.append(text[at : max(a, at)])
            at = max(z, at)
    return "".join([*out, text[at:]])


def without_leaks(documents: DataFrame, items: DataFrame, remove: str = "spans", block_chars: int = BLOCK_CHARS, group_chars: int = GROUP_CHARS) -> DataFrame:
    """(doc_id, text, n_leaks) of all documents, without what leaked: its spans, or the documents that hold any
    ('documents'). n_leaks counts the leaked stretches found.

    Spans are cut from the first to the end of the last word; documents without leaks keep their text as it is, null too.
    Found and cut in one scan, where the documents lie: nothing is shuffled, no text is sent about.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    blocks, forms = _Blocks(items, block_chars), confusables(documents.sparkSession)
    d = need(documents, "doc_id", "text")
    several = len(blocks.shared) > 1
    kind = dict(d.dtypes)["doc_id"]

    def clean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = WordHashes()
        for frame in _grouped(frames, group_chars) if several else frames:
            spans: dict[int, set[tuple[int, int]]] = {}
            for t, _, _, _, first, end in _scanned(frame, blocks, forms, hashed):
                spans.setdefault(t, set()).add((first, end))
            texts = [_cut(x, list(spans[t]), forms) if t in spans else x for t, x in enumerate(frame["text"])]
            out = pd.DataFrame({"doc_id": frame["doc_id"], "text": pd.Series(texts, dtype=object, index=frame.index), "n_leaks": [len(spans.get(t, ())) for t in range(len(frame))]})
            yield out if remove == "spans" else out[out["n_leaks"] == 0]

    return d.mapInPandas(clean, f"doc_id {kind}, text string, n_leaks int")
