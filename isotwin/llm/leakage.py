"""Evaluation texts leaking into pages.

Method: rare n-gram seeds join the pages to the test items, then Smith-Waterman alignment scores the seeded stretches.
Seeds are runs of ``SEED`` letters of an item after folding letters that scanners confuse, so that line ends, word breaks
and misread letters do not part them; a seed is rare if few of all pages hold it. One rare seed is enough: the letters around it are
compared along its diagonal, and where they too are alike, page and item are aligned. An item is found where ten or more successive
words of it are aligned.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotwin.llm.pages import page_columns, reading_order
from isotwin.session import cut

#: Letters in a seed; a folded letter takes five bits, so a seed is one 64-bit number. Of 40 letters with four misread, eight in a row are whole.
SEED = 8
#: A seed is rare if at most this share of all pages hold it, or ``RARE_PAGES`` pages.
RARE_SHARE, RARE_PAGES = 0.03, 20
#: Where an item's seeds are common over a long stretch, the rarer half of every so many successive ones is searched for all the same.
STRETCH = 16
#: Around a seed so many blocks of ``SEED`` letters are compared on either side, shifted by up to ``SHIFT`` letters. A block counts its
#: equal letters less ``CHANCE``; page and item are aligned if the blocks from the seed outwards bring at least ``ALIKE``.
BLOCKS, SHIFT, CHANCE, ALIKE = 4, 2, 3.5, 9.0
#: Letters of the item aligned beyond the outermost seeds.
MARGIN = 60
#: Half the width of the alignment's band, in letters.
BAND = 20
#: Alignment scores.
MATCH, MISMATCH, GAP = 3, -2, -4
#: Inserted letters between two words from which they no longer follow one another.
BREAK = 6
#: About how many letters of items are taken in one pass over the pages; more are taken in blocks.
BLOCK_LETTERS = 2_000_000
#: Words of an item that are searched as one; longer items are cut into pieces that share ``OVERLAP`` words and more than any ``least_words``.
PIECE_WORDS, OVERLAP = 20_000, 50
#: Cells of the alignment's band held at a time.
CELLS = 1 << 23

#: Letters that scanners confuse, each folded to the second of its pair.
CONFUSED = {"i": "l", "1": "l", "j": "l", "s": "f", "e": "c", "y": "v", "h": "b", "0": "o", "u": "n"}
#: Letter pairs that scanners take for one letter, folded first.
CONFUSED_PAIRS = ((b"rn", b"m"), (b"cl", b"d"), (b"vv", b"w"))
_ALPHABET = sorted({CONFUSED.get(c, c) for c in "abcdefghijklmnopqrstuvwxyz0123456789"})
_KEEP = bytes(b for b in range(256) if not (chr(b).isascii() and chr(b).isalnum()))
_FOLD = bytes.maketrans("".join(CONFUSED).encode(), "".join(CONFUSED.values()).encode())
_CODE = np.zeros(256, np.uint8)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(1, len(_ALPHABET) + 1)
assert len(_ALPHABET) < 32
#: An advert that stands within an article, with the rules above and below it.
_ADVERT = re.compile(r"^\*{3,}$(.*?)^-{3,}$", re.S | re.M)


def folded(text: str) -> bytes:
    """The letters and digits of ``text``, without case, accents, punctuation and blanks, confusable ones folded together."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    s = text.lower().encode("ascii", "ignore").translate(None, _KEEP)
    for a, b in CONFUSED_PAIRS:
        s = s.replace(a, b)
    return s.translate(_FOLD)


def folded_page(pieces: list[tuple[int, str, int]]) -> bytes:
    """A page's letters in reading order, its adverts after its articles."""
    text = "\n".join(p for _, p, _ in pieces)
    adverts: list[str] = []
    if "***" in text:
        text = _ADVERT.sub(lambda m: adverts.append(m[1]) or "", text)
    return folded("\n".join((text, *adverts)))


def _seeds(stream: np.ndarray) -> np.ndarray:
    """The seed that begins at each letter of ``stream`` (codes), the last ``SEED - 1`` excepted."""
    n = len(stream) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SEED):
        out <<= np.uint64(5)
        out |= stream[k : k + n]
    return out


class Items:
    """The test items as arrays: letters, words, and the seeds with the places where they stand."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.ids, self.letters, self.words = [], [], []
        for item, text in rows:
            whole, lengths = _folded_words(text or "")
            self.ids.append(item)
            self.letters.append(_CODE[np.frombuffer(whole, np.uint8)])
            self.words.append(np.cumsum([0, *lengths]))
        self.sizes = np.array([len(x) for x in self.letters], int)
        # The letters one after another, with room around each item, so that blocks beside a seed may reach over its ends.
        room = np.full(_ROOM, 31, np.uint8)
        self.codes = _seeds(np.concatenate([room, *(x for letters in self.letters for x in (letters, room))]))
        self.base = _ROOM + np.cumsum([0, *(self.sizes + _ROOM)])[:-1]
        counts = np.maximum(self.sizes - SEED + 1, 0)
        owner = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        order = np.argsort(self.codes[self.base[owner] + place], kind="stable")
        self.owner, self.place = owner[order].astype(np.int32), place[order].astype(np.int32)
        self.seeds, first = np.unique(self.codes[self.base[self.owner] + self.place], return_index=True)
        self.first = np.concatenate((first, [len(order)]))
        self.bits = 64 - max(20, int(8 * len(self.seeds)).bit_length())
        self.keep(np.ones(len(order), bool))

    def keep(self, places: np.ndarray) -> None:
        """Search with the seeds at these of the ``places`` only."""
        self.kept = places
        self.sieve = np.zeros(1 << (64 - self.bits), bool)
        self.sieve[_slot(self.seeds[np.add.reduceat(places, self.first[:-1]) > 0] if len(self.seeds) else self.seeds, self.bits)] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``codes`` where a seed that is searched with stands, and which one."""
        where = np.flatnonzero(self.sieve[_slot(codes, self.bits)])
        if not len(self.seeds):
            return where[:0], where[:0]
        k = np.minimum(np.searchsorted(self.seeds, codes[where]), len(self.seeds) - 1)
        ok = self.seeds[k] == codes[where]
        return where[ok], k[ok]

    def rare(self, held: np.ndarray, limit: float) -> np.ndarray:
        """The places to search with, if ``held`` pages hold each seed: those of rare seeds, and of each ``STRETCH`` of an item the rarer half."""
        own = np.repeat(held, np.diff(self.first))
        stretch = self.owner.astype(np.int64) << 32 | self.place // STRETCH
        order = np.lexsort((self.place, own, stretch))
        begins = np.concatenate(([True], np.diff(stretch[order]) > 0)) if len(order) else np.zeros(0, bool)
        sizes = np.diff(np.concatenate((np.flatnonzero(begins), [len(order)])))
        rank = np.arange(len(order)) - np.repeat(np.flatnonzero(begins), sizes)
        out = own <= limit
        out[order[2 * rank < np.repeat(sizes, sizes)]] = True
        return out


def _slot(codes: np.ndarray, bits: int) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(bits)


def _folded_words(text: str) -> tuple[bytes, list[int]]:
    """``folded(text)`` and the letters that each word has in it, a pair folded across words counting for the first."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    words = [w.lower().encode("ascii", "ignore").translate(None, _KEEP) for w in text.split()]
    letters = b"".join(words)
    owner = [k for k, w in enumerate(words) for _ in w]
    for a, b in CONFUSED_PAIRS:
        while (i := letters.find(a)) >= 0:
            letters = letters[:i] + b + letters[i + 2 :]
            del owner[i + 1]
    counts = np.bincount(np.array(owner, int), minlength=len(words))
    return letters.translate(_FOLD), [int(n) for n in counts if n]


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Pieces of few rows, so that a task's arrays stay small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _streams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pages' letters as codes one after another, parted by zeros, the seed that begins at each, and each letter's page."""
    pages = [folded_page(p) for p in reading_order(batch)]
    gap = b"\x00" * SEED
    stream = _CODE[np.frombuffer(gap.join(pages) + gap, np.uint8)]
    return stream, _seeds(stream), np.repeat(np.arange(len(pages)), [len(p) + SEED for p in pages])


#: Room around an item's letters for the blocks beside a seed.
_ROOM = (BLOCKS + 1) * SEED
_LOW_BITS = np.uint64(sum(1 << 5 * k for k in range(SEED)))


def _equal_letters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many of their letters two seeds are equal."""
    x = a ^ b
    for k in (1, 2, 4):
        x |= (a ^ b) >> np.uint64(k)
    x |= (a ^ b) >> np.uint64(3)
    return SEED - np.bitwise_count(x & _LOW_BITS).astype(np.int8)


def _alike(codes: np.ndarray, own: Items, where: np.ndarray, item: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """What the blocks beside seeds bring, those to the left of ``first`` and to the right of ``last`` (places in the item of the outermost
    seeds on one diagonal; ``where`` is that of ``first`` in the page)."""
    total = np.zeros(len(where))
    for side in (-1, 1):
        gain, best = np.zeros(len(where)), np.zeros(len(where))
        edge = first if side < 0 else last
        for j in range(1, BLOCKS + 1):
            here = own.base[item] + edge + side * j * SEED
            there = where + (edge - first) + side * j * SEED
            letters = own.codes[np.clip(here, 0, len(own.codes) - 1)]
            same = np.zeros(len(where), np.int8)
            for shift in range(-SHIFT, SHIFT + 1):
                same = np.maximum(same, _equal_letters(letters, codes[np.clip(there + shift, 0, len(codes) - 1)]))
            gain += same - CHANCE
            best = np.maximum(best, gain)
        total += best
    return total


def longest_runs(page: np.ndarray, starts: np.ndarray, items: Items, which: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smith-Waterman in a band: for each candidate the most successive words of the item aligned with ``page``.

    A candidate is an item (``which``) and the place in ``page`` on which the item's first letter would stand (``starts``); the item's
    letters from ``low`` to before ``high`` are aligned. Letters are scored ``MATCH``, ``MISMATCH`` and ``GAP``; the best local alignment is
    traced back. Candidates of like length are aligned together, as many as ``CELLS`` allows.
    """
    out = np.zeros(len(which), int)
    order = np.argsort(high - low, kind="stable")
    while len(order):
        n = max(1, min(len(order), 512, CELLS // int((high - low)[order[min(len(order), 512) - 1]] * (2 * BAND + 1) + 1)))
        some, order = order[:n], order[n:]
        out[some] = _aligned(page, starts[some], items, which[some], low[some], high[some])
    return out


def _aligned(page: np.ndarray, starts: np.ndarray, items: Items, which: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``longest_runs`` of candidates that fit in memory at once."""
    if not len(which):
        return np.zeros(0, int)
    width, n = 2 * BAND + 1, len(which)
    size = high - low
    top = int(size.max())
    letters = np.full((n, top), 99, np.uint8)
    for k, i in enumerate(which):
        letters[k, : size[k]] = items.letters[i][low[k] : high[k]]
    padded = np.concatenate((np.zeros(top + width, np.uint8), page, np.zeros(2 * top + 2 * width, np.uint8)))
    base = starts + low + top + width - BAND
    # Rows of a band lie along the page, one letter further for each letter of the item.
    reach = padded[base[:, None] + np.arange(top + width - 1)]
    windows = np.lib.stride_tricks.sliding_window_view(reach, width, axis=1)
    score = np.zeros((n, width + 1), np.int32)
    score[:, width] = -(1 << 20)
    moves = np.zeros((top, n, width), np.int8)
    best, best_at = np.zeros(n, np.int32), np.zeros((n, 2), int)
    slide = (np.arange(width) * -GAP).astype(np.int32)
    rows = np.arange(n)
    for i in range(top):
        same = windows[:, i] == letters[:, i : i + 1]
        diagonal = score[:, :width] + np.where(same, np.int32(MATCH), np.int32(MISMATCH))
        now = np.maximum(np.maximum(diagonal, score[:, 1:] + np.int32(GAP)), 0)
        carried = np.maximum.accumulate(now + slide, axis=1) - slide
        move = np.where(now == diagonal, np.where(same, np.int8(1), np.int8(2)), np.int8(3))
        move[now == 0] = 0
        move[carried > now] = 4
        score[:, :width] = carried
        moves[i] = move
        peak = carried.argmax(axis=1)
        value = carried[rows, peak]
        better = value > best
        best[better], best_at[better, 0], best_at[better, 1] = value[better], i, peak[better]
    matched = np.full((n, top), -1, int)
    i, b = best_at[:, 0].copy(), best_at[:, 1].copy()
    live = np.flatnonzero(best > 0)
    while len(live):
        m = moves[i[live], live, b[live]]
        hit = live[m == 1]
        matched[hit, i[hit]] = i[hit] + b[hit]
        straight, down, left = live[(m == 1) | (m == 2)], live[m == 3], live[m == 4]
        i[straight] -= 1
        i[down] -= 1
        b[down] += 1
        b[left] -= 1
        live = live[(m != 0) & (i[live] >= 0) & (b[live] >= 0) & (b[live] < width)]
    out = np.zeros(n, int)
    for k, w in enumerate(which):
        whole = np.full(len(items.letters[w]), -1)
        whole[low[k] : high[k]] = matched[k, : size[k]]
        out[k] = _words_in_a_row(whole, items.words[w])
    return out


def _words_in_a_row(matched: np.ndarray, ends: np.ndarray) -> int:
    """The most successive words that are aligned, few letters of each missing and nothing much inserted between.

    A word of one or two letters begins or ends a run only if it is whole, as one of its letters may agree by chance.
    """
    run = most = 0
    last = None
    for a, b in zip(ends[:-1], ends[1:]):
        own = matched[a:b]
        got = own[own >= 0]
        size = b - a
        whole = len(got) == size or size > 2
        good = len(got) >= size - max(1, round(0.3 * size)) and bool(run or whole)
        if good and len(got) and got[-1] - got[0] - size > BREAK:
            good = False
        if good and run and len(got) and last is not None and got[0] - last > BREAK + size - len(got):
            run = 0
            good = whole
        if good:
            run += 1
            if len(got):
                last = got[-1]
            if whole:
                most = max(most, run)
        else:
            run, last = 0, None
    return most


def leaked(pages: DataFrame, items: DataFrame, least_words: int = 10) -> DataFrame:
    """``doc_id, item_id`` for each page that holds ``least_words`` or more successive words of an item, once.

    ``pages``: ``doc_id, text, boxes`` (arrays of structs with ``x0`` and ``y0``). ``items``: ``item_id, text``, taken in blocks of about
    ``BLOCK_LETTERS``, so what is on the driver and sent to the tasks is bounded. Pages are read whole, column by column; adverts set within
    articles do not part a passage. Null and empty texts give nothing, as do items of fewer than ``least_words`` words; pages stored twice
    are both found. Items of equal text are all found. Other columns are not read.

    Scale: two passes over the pages per block of items (page counts of the items' seeds, then seeding and alignment) and no shuffle of
    pages or seeds: only the counts, one per seed of a block, are gathered. A seed's rarity is measured over all pages.
    """
    spark = pages.sparkSession
    slim = pages.where("text is not null").select("doc_id", *page_columns())
    out, many = None, False
    for block in _blocks(items.where("text is not null and item_id is not null").select("item_id", "text"), least_words):
        if out is not None:
            # More than one block: what was found is kept, and the block's arrays go.
            many = True
            out = cut(out)
        found = _leaked_block(slim, block, least_words)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint")
    return out.distinct() if many else out


def _blocks(items: DataFrame, least_words: int) -> Iterator[Items]:
    """The items, the longest cut into overlapping pieces, in blocks."""
    rows: list[tuple[int, str]] = []
    letters, overlap = 0, max(OVERLAP, 2 * least_words)
    for r in items.toLocalIterator():
        words = r["text"].split()
        for k in range(0, max(1, len(words) - overlap), PIECE_WORDS):
            piece = " ".join(words[k : k + PIECE_WORDS + overlap])
            if rows and letters + len(piece) > BLOCK_LETTERS:
                yield Items(rows)
                rows, letters = [], 0
            rows.append((r["item_id"], piece))
            letters += len(piece)
    if rows:
        yield Items(rows)


def _leaked_block(slim: DataFrame, block: Items, least_words: int) -> DataFrame:
    spark = slim.sparkSession
    sent = spark.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        total, n = np.zeros(len(own.seeds), np.int64), 0
        for batch in _sliced(batches):
            _, codes, page = _streams(batch)
            where, k = own.hits(codes)
            pairs = np.unique(page[where] * np.int64(len(own.seeds) + 1) + k)
            np.add.at(total, pairs % (len(own.seeds) + 1), 1)
            n += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], some))), pa.array(np.concatenate(([n], total[some])))], names=["seed", "n"])

    counts = slim.mapInArrow(count, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    seed, n = (counts.column(c).to_numpy() for c in ("seed", "n"))
    held = np.zeros(len(block.seeds), np.int64)
    held[seed[seed >= 0]] = n[seed >= 0]
    kept = spark.sparkContext.broadcast(block.rare(held, max(RARE_PAGES, RARE_SHARE * n[seed < 0].sum())))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        own.keep(kept.value)
        for batch in _sliced(batches):
            stream, codes, page = _streams(batch)
            place, item, found = _candidates(codes, page, own)
            low, high, start = found
            runs = longest_runs(stream, start, own, item, low, high)
            hit = runs >= least_words
            pairs = sorted({(int(p), own.ids[i]) for p, i in zip(place[hit], item[hit])})
            if pairs:
                docs = batch.column("doc_id").take(pa.array([p for p, _ in pairs]))
                yield pa.RecordBatch.from_arrays([docs.cast(pa.int64()), pa.array([i for _, i in pairs], pa.int64())], names=["doc_id", "item_id"])

    return slim.mapInArrow(align, "doc_id bigint, item_id bigint")


def _candidates(codes: np.ndarray, page: np.ndarray, own: Items) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pages, items and stretches (from, to, and where in the page the item would begin) to be aligned."""
    where, k = own.hits(codes)
    times = own.first[k + 1] - own.first[k]
    at = np.repeat(own.first[k], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    where, at = np.repeat(where, times)[own.kept[at]], at[own.kept[at]]
    item, place = own.owner[at].astype(np.int64), own.place[at].astype(np.int64)
    start = where - place
    # Seeds on one diagonal of an item that follow within a seed's length are one stretch.
    order = np.argsort(item << 40 | start + (1 << 32), kind="stable")
    where, item, place, start = where[order], item[order], place[order], start[order]
    fresh = np.ones(len(where), bool)
    fresh[1:] = (item[1:] != item[:-1]) | (start[1:] != start[:-1]) | (where[1:] - where[:-1] > SEED)
    heads = np.flatnonzero(fresh)
    sizes = np.diff(np.concatenate((heads, [len(where)])))
    tails = heads + sizes - 1
    where, item, start, first, last = where[heads], item[heads], start[heads], place[heads], place[tails]
    good = np.minimum(last - first, 2 * SEED) * 0.75 + _alike(codes, own, where, item, first, last) >= ALIKE
    where, item, start, first, last = where[good], item[good], start[good], first[good], last[good]
    # Stretches of a pair on diagonals near one another are aligned together; where they spread wider than BAND, in bands of twice BAND
    # diagonals, each overlapping half of the next, so that no passage lies astride two.
    n = len(own.ids)
    pair = page[where] * n + item
    order = np.lexsort((start, pair))
    pair, start, first, last = pair[order], start[order], first[order], last[order]
    fresh = np.ones(len(pair), bool)
    fresh[1:] = (pair[1:] != pair[:-1]) | (np.diff(start) > BAND)
    chain = np.cumsum(fresh) - 1
    heads = np.flatnonzero(fresh)
    away = start - start[heads][chain]
    wide = (np.maximum.reduceat(away, heads) > BAND)[chain] if len(heads) else fresh
    band = np.where(wide, away // BAND + 1, 0)
    keys = np.concatenate((chain << 32 | band, (chain << 32 | band + 1)[wide]))
    start, first, last = (np.concatenate((x, x[wide])) for x in (start, first, last))
    groups, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    middle = np.rint(np.bincount(inverse, start, len(groups)) / count).astype(int)
    low, high = np.full(len(groups), 1 << 40), np.zeros(len(groups), int)
    np.minimum.at(low, inverse, first)
    np.maximum.at(high, inverse, last + SEED)
    pair = pair[heads][groups >> 32]
    return pair // n, pair % n, (np.maximum(low - MARGIN, 0), np.minimum(high + MARGIN, own.sizes[pair % n]), middle)
