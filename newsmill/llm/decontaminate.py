"""Benchmark passages in documents: CGK embedding, bit-sampling LSH, exact edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsmill.llm.common import pick
from newsmill.llm.toxicity import text_buffers
from newsmill.session import durable

FOUND = "array<struct<item: long, start: int, end: int, edits: int>>"


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A-Z in lower case, each run of blanks as one space."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[9:14] = 32
    x = table[data]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    keep[offsets[:-1][offsets[:-1] < len(x)]] = True
    sums = np.concatenate(([0], np.cumsum(keep)))
    return x[keep], sums[offsets]


def edit_distance_within(pattern: bytes, text: bytes) -> tuple[int, int]:
    """(least edit distance between the pattern and any stretch of the text, where the first
    such stretch ends).  Bit-parallel columns of the distance matrix."""
    m = len(pattern)
    at: dict[int, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        hp = minus | (full & ~(xh | plus))
        hm = plus & xh
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        if score < best:
            best, end = score, j + 1
        hp, hm = (hp << 1) & full, (hm << 1) & full
        plus = hm | (full & ~(xv | hp))
        minus = hp & xv
    return best, end


class Walks:
    """Random walks over strings (Chakraborty, Goldenberg, Koucky).

    At step t a walk writes the letter it stands on, and steps on or not by a random bit that
    depends on t and the letter.  Strings a few edits apart meet again after each edit, so
    their embeddings differ in few places.  ``tables`` repeats of sampling ``letters`` places,
    spread over ``walks`` walks, give the LSH keys.
    """

    def __init__(self, tables: int, letters: int, walks: int, seed: int) -> None:
        self.walks = walks
        self.shape = ceil(tables / walks), letters
        self.seed = seed

    def embed(self, strings: np.ndarray, sizes: np.ndarray, walk: int) -> np.ndarray:
        """A column of letters per row of ``strings`` (padded with zeros), two steps a byte."""
        count, width = strings.shape
        rng = np.random.default_rng((self.seed, walk))
        out = np.zeros((2 * width, count), np.uint8)
        flat = np.concatenate((strings, np.zeros((count, 1), np.uint8)), axis=1).reshape(-1)
        first = np.arange(count) * (width + 1)
        at, last = first.copy(), first + sizes
        for t in range(2 * width):
            step = rng.integers(0, 2, 256, dtype=np.int64)
            letter = flat[at]
            out[t] = letter
            at = np.minimum(at + step[letter], last)
        return out

    def places(self, walk: int) -> np.ndarray:
        """The sampled steps, as shares of all steps: a row per table."""
        return np.random.default_rng((self.seed, walk, 1)).random(self.shape)


def stretches(data: np.ndarray, start: np.ndarray, size: np.ndarray, way: int, width: int) -> np.ndarray:
    """A row per start: ``size`` bytes from there on, forward or (way -1) backward, then zeros."""
    j = np.arange(width)
    inside = j < size[:, None]
    return np.where(inside, data[np.where(inside, start[:, None] + way * j, 0)], 0).astype(np.uint8)


def runs(same: np.ndarray) -> np.ndarray:
    """How many columns hold from the first on, by row."""
    return np.where(same.all(axis=1), same.shape[1], np.argmin(same, axis=1)) if same.shape[1] else np.zeros(len(same), np.int64)


SEED_BYTES = (8, 5, 3, 2, 1)
PAIRS = 1 << 18
CELLS = 1 << 23
ODD = np.uint64(0x9E3779B97F4A7C15)


class Benchmark:
    """The items of one block, ready to be looked for.

    An item with room for e edits is cut into e // 2 + 1 parts.  However e edits fall, a part
    has at most one, so one of its halves stands in the text as it is and the other next to it
    with at most one edit.  Such places are where an item can stand; none is missed.
    """

    def __init__(self, items: list[tuple[int, bytes]], share: float, walks: Walks) -> None:
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.edits = [int(len(t) * share) for t in self.texts]
        self.walks = walks
        self.data = np.frombuffer(b"".join(self.texts) + bytes(8), np.uint8)
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.base = np.concatenate(([0], np.cumsum(self.sizes)))
        kinds: dict[tuple[bytes, bytes, int], int] = {}
        places: list[tuple[int, ...]] = []
        uses: list[tuple[int, int, int]] = []
        for k, t in enumerate(self.texts):
            parts = self.edits[k] // 2 + 1
            cuts = [len(t) * i // parts for i in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:]):
                c = (a + b + 1) // 2
                for lo, hi, x, y, way in ((a, c, c, b, 1), (c, b, a, c, -1)):
                    if lo == hi:
                        continue
                    kind = kinds.setdefault((t[lo:hi], t[x:y], way), len(kinds))
                    if kind == len(places):
                        places.append((self.base[k] + lo, hi - lo, self.base[k] + x, y - x, way))
                    uses.append((kind, k, lo))
        self.own, self.own_size, self.other, self.other_size, self.way = (
            np.array(places, np.int64).reshape(-1, 5).T
        )
        used = np.array(sorted(uses), np.int64).reshape(-1, 3)
        self.first_use = np.searchsorted(used[:, 0], np.arange(len(places) + 1))
        self.item, self.offset = used[:, 1], used[:, 2]
        self.seeds = []
        left = np.ones(len(places), bool)
        for q in SEED_BYTES:
            mine = np.flatnonzero(left & (self.own_size >= q))
            left[mine] = False
            if len(mine):
                grams = self.grams(self.data, q)[self.own[mine]]
                order = np.argsort(grams, kind="stable")
                maybe = np.zeros(1 << 20, bool)
                maybe[self.slot(grams)] = True
                self.seeds.append((q, grams[order], mine[order], maybe))

    @staticmethod
    def grams(data: np.ndarray, q: int) -> np.ndarray:
        """The q bytes from each byte on, as numbers; the last 8 bytes of the data start none."""
        grams = np.ndarray(max(0, len(data) - 8), "<u8", np.ascontiguousarray(data), strides=(1,))
        return grams & np.uint64((1 << 8 * q) - 1)

    @staticmethod
    def slot(grams: np.ndarray) -> np.ndarray:
        return (grams * ODD >> np.uint64(44)).astype(np.int64)

    def near(self, data: np.ndarray, at: np.ndarray, kind: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which places have the kind's own half at ``at`` and the other, within one edit, next to it."""
        size = self.own_size[kind]
        fits = np.flatnonzero(at + size <= hi)
        j = np.arange(size[fits].max(initial=0))
        cell = j < size[fits, None]
        mine, theirs = self.own[kind[fits], None] + j, at[fits, None] + j
        same = self.data[np.where(cell, mine, 0)] == data[np.where(cell, theirs, 0)]
        fits = fits[(same | ~cell).all(axis=1)]

        kind, lo, hi, way = kind[fits], lo[fits, None], hi[fits, None], self.way[kind[fits], None]
        size = self.other_size[kind]
        width = int(size.max(initial=0))
        j = np.arange(width)
        cell = j < size[:, None]
        from_item = self.other[kind, None] + np.where(way > 0, 0, size[:, None] - 1)
        from_text = at[fits, None] + np.where(way > 0, self.own_size[kind, None], -1)
        letters = self.data[np.where(cell, from_item + way * j, 0)]

        def same_at(shift: int) -> np.ndarray:
            place = from_text + way * (j + shift)
            inside = cell & (place >= lo) & (place < hi)
            return (inside & (letters == data[np.where(inside, place, 0)])) | ~cell

        straight = same_at(0)
        head, spare = runs(straight), width - size
        replaced = head + runs(straight[:, ::-1]) - spare >= size - 1
        longer = head + runs(same_at(1)[:, ::-1]) - spare >= size
        shorter = head + runs(same_at(-1)[:, ::-1]) - spare >= size - 1
        return fits[replaced | longer | shorter]

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, item, byte of the item, place of this byte in the data), in bounded batches.

        ``data`` ends with 8 bytes of no text."""
        for q, grams, kinds, maybe in self.seeds:
            of_text = self.grams(data, q)
            at = np.flatnonzero(maybe[self.slot(of_text)])
            lo = np.searchsorted(grams, of_text[at], "left")
            n = np.searchsorted(grams, of_text[at], "right") - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            for which, entry in expand(lo, n):
                place, kind = at[which], kinds[entry]
                row = np.searchsorted(offsets, place, "right") - 1
                ok = self.near(data, place, kind, offsets[row], offsets[row + 1])
                place, kind, row = place[ok], kind[ok], row[ok]
                for which, use in expand(self.first_use[kind], self.first_use[kind + 1] - self.first_use[kind]):
                    yield row[which], self.item[use], self.offset[use], place[which]

    def collide(
        self, data: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, offset: np.ndarray
    ) -> np.ndarray:
        """Does the item-sized window whose byte ``at`` is the item's byte ``offset`` share an LSH
        key with the item?  Walks start at this byte, one to the end and one to the beginning."""
        after, mine = self.sizes[item] - offset, self.base[item] + offset
        hit = np.zeros(len(at), bool)
        for walk in range(self.walks.walks):
            i = np.flatnonzero(~hit)
            if not len(i):
                break
            right, left = int(after[i].max()), int(offset[i].max())
            text, own = [], []
            for start, shift, way, size, width in ((at, 0, 1, after, right), (at, -1, -1, offset, left)):
                room = hi - at if way > 0 else at - lo
                for out, source, first, n in (
                    (text, data, start + shift, np.minimum(size, room)), (own, self.data, mine + shift, size)
                ):
                    out.append(self.walks.embed(stretches(source, first[i], n[i], way, width), n[i], walk))
            steps = (self.walks.places(walk)[..., None] * (2 * self.sizes[item[i]])).astype(np.int64)
            turn = 2 * after[i]
            rows = np.where(steps < turn, steps, steps - turn + 2 * right)
            each = np.arange(len(i))
            same = np.concatenate(text)[rows, each] == np.concatenate(own)[rows, each]
            hit[i] = same.all(axis=1).any(axis=0)
        return hit

    def search(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits), each item once a text, where it fits best."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        for batch in self.candidates(padded, offsets):
            longest = int(self.sizes[batch[1]].max(initial=1))
            size = max(1, CELLS // longest)
            for part in range(0, len(batch[0]), size):
                row, item, offset, at = (x[part : part + size] for x in batch)
                lo, hi = offsets[row], offsets[row + 1]
                hit = self.collide(padded, at, lo, hi, item, offset)
                found = np.unique(np.stack([row, item, at - offset])[:, hit], axis=1)
                for r, k, s in found.T.tolist():
                    room = self.edits[k]
                    a = max(s - room, int(offsets[r]))
                    b = min(s + len(self.texts[k]) + room, int(offsets[r + 1]))
                    edits, end = edit_distance_within(self.texts[k], data[a:b].tobytes())
                    fit = edits, end + a - int(offsets[r])
                    if edits <= room and fit < best.get((r, k), (room + 1, 0)):
                        best[r, k] = fit
        for (row, k), (edits, end) in best.items():
            yield row, self.ids[k], max(0, end - len(self.texts[k])), end, edits


def expand(lo: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, entry) for each entry lo[i] to lo[i] + n[i], in batches of about ``PAIRS``."""
    total = np.concatenate(([0], np.cumsum(n)))
    first = 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(total, total[first] + PAIRS, "right")) - 1)
        which = np.repeat(np.arange(first, last), n[first:last])
        yield which, lo[which] + np.arange(len(which)) - (total[which] - total[first])
        first = last


def tables_for(recall: float, agreement: float, letters: int) -> int:
    """Repeats after which two strings whose embeddings agree in a share ``agreement`` of places
    have met with probability ``recall``."""
    return ceil(log(1 - recall) / log(1 - agreement**letters))


def passage_finders(
    benchmark: DataFrame,
    id_col: str = "item_id",
    text_col: str = "text",
    share: float = 0.1,
    recall: float = 0.99,
    agreement: float = 0.35,
    letters: int = 3,
    block_bytes: int = 4 << 20,
    seed: int = 42,
) -> Iterator[tuple[int, object]]:
    """(blocks, function of a text column) for each block of the benchmark: the passages found.

    A passage is a stretch at most ``share`` (under a half) of the item's length in edits from
    the item, both in UTF-8 bytes with A-Z lower-cased and blanks as single spaces.  Windows of
    an item's size are looked at where a part of the item stands with at most one edit, which
    misses no passage (see ``Benchmark``).  They are embedded by CGK walks; those that meet the
    item in one of the sampled LSH tables are verified by exact edit distance with the text
    around.  ``tables_for`` sets the number of tables from ``recall`` and the ``agreement`` that
    embeddings ``share`` edits apart still have.  Items of all lengths go the same way; empty
    and null items are never found.

    The benchmark goes to the executors in blocks of about ``block_bytes``, each scanned
    against all texts; its size does not matter otherwise.  A block is fetched when it is asked
    for.
    """
    if not 0 <= share < 0.5:
        raise ValueError("share must be at least 0 and under 0.5")
    items = pick(benchmark, item=id_col, text=text_col).where("item is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, ceil(total / block_bytes))
    walks = Walks(tables_for(recall, agreement, letters), letters, 4, seed)
    for b in range(blocks):
        yield blocks, _finder(items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b), share, walks)


def _finder(items: DataFrame, share: float, walks: Walks):
    rows = [(int(r.item), r.text) for r in items.collect()]
    sent = items.sparkSession.sparkContext.broadcast(rows)
    kept: list[Benchmark] = []

    def block() -> Benchmark:
        if not kept:
            plain = []
            for item, text in sent.value:
                data = np.frombuffer(text.encode(), np.uint8)
                plain.append((item, normalised(data, np.array([0, len(data)]))[0].tobytes().strip()))
            kept.append(Benchmark(plain, share, walks))
        return kept[0]

    kind = pa.list_(
        pa.struct([("item", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())])
    )

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        out: list[list] = [[] for _ in range(len(texts))]
        for first, data, offsets in text_buffers(texts):
            for row, item, start, end, edits in block().search(*normalised(data, offsets)):
                out[first + row].append({"item": item, "start": start, "end": end, "edits": edits})
        return pa.array([sorted(x, key=lambda d: d["item"]) for x in out], kind)

    return find


def contaminated(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """A row per document and benchmark item found in it: doc_id, item_id, start, end, edits.

    start and end are bytes of the normalised text; start is exact to within edits.  Texts do
    not move: each partition is scanned where it is.  Null and empty texts have no passages.
    Repeated rows are reported each; repeated items once per row of the benchmark.
    """
    texts = pick(df, doc_id=id_col, text=text_col)
    out = None
    for blocks, find in passage_finders(benchmark, **options):
        part = texts.select("doc_id", F.explode(find("text")).alias("f"))
        part = part.select("doc_id", F.col("f.item").alias("item_id"), "f.start", "f.end", "f.edits")
        if blocks > 1:
            part = durable(part, "passages")
        out = part if out is None else out.unionByName(part)
    return out


def clean_documents(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows, columns as they are, whose text holds no passage of the benchmark."""
    for blocks, find in passage_finders(benchmark, **options):
        df = df.where(F.coalesce(F.size(find(F.col(f"`{text_col}`"))), F.lit(0)) == 0)
        if blocks > 1:
            df = durable(df, "clean")
    return df
