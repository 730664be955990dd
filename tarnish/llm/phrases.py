"""Phrase collocations, counted with broadcast double-array tries.

Texts are read once: each becomes the 64-bit hashes of its words, with zeros between pieces, and the
words are counted on the way. From there on only numpy looks at texts.

Candidates are found length by length, after Apriori: a window of ``k`` words is looked at only where
both windows of ``k - 1`` words inside it are frequent. Windows are known by a 64-bit code then, so two
may share a code, but their common count is no less than that of either: nothing frequent is lost.
Frequent codes go to the tasks as a bitmap of fixed size, and what falls on set bits by chance is
looked at in vain. With its count every frequent code has the mark of one text that holds it, so the
phrase behind it is given by the texts of that mark and not by every task. Where the phrases found fall
short of their code's count, two phrases share the code, and all texts are asked for that code.

The phrases behind the frequent codes are dealt over tries of a bounded number of phrases. A trie's
alphabet is its own words, each written as two symbols; its states lie in a double array, where state
``s`` goes on with symbol ``c`` to ``base[s] + c`` if ``check`` of that place is ``s``. A few tries at a time are broadcast, and a
task advances the states of all positions of a chunk of text at once, word by word, and counts the states
that are reached. These exact counts, summed over all tasks, replace those by code.

Scores join every phrase with the counts of its parts; phrases inside longer ones with nearly their
count are dropped, and each group's first ones are ranked in two steps, so no group is sorted in one task.

Defined cases: a null text is empty; a null group is ``und``; repeated rows count as often as they
occur; other columns are not looked at,
and an empty table has no phrases.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tarnish.llm.minhash import mix
from tarnish.llm.texts import raw_texts
from tarnish.session import materialise, parallelism

LEAST, LONGEST, TOP = 30, 4, 2000
#: Bits of the bitmap of frequent codes: 8 MB, whatever the corpus.
BITS = 1 << 26
#: Phrases per trie.
TRIE = 1 << 18
#: Tries per pass over the texts.
TOGETHER = 4
#: Texts are marked by a number below this; counts travel in the bits above it.
MARK_BITS = 8
#: Words remembered and counted by a task, positions advanced at a time, codes held, and phrases a task recalls.
REMEMBERED, COUNTED, POSITIONS, HELD, SEEN = 1 << 16, 1 << 16, 1 << 18, 1 << 20, 1 << 19
#: A word is two steps in a trie, so that no state has more than so many ways on; lists of up to SHORT are dealt at random.
SYMBOLS, SHORT = 512, 16
#: Texts in a batch that a task gives back.
TEXTS = 500

#: What ends a piece becomes a byte that no UTF-8 text has.
BREAK = b"\xff"
BREAKS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", BREAK * 10)

_rng = np.random.default_rng(20250817)
PLACES = _rng.integers(0, 1 << 64, LONGEST, np.uint64) | np.uint64(1)
WORDS = [f"w{i}" for i in range(LONGEST)]


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased words, with :data:`BREAK` between pieces."""
    return raw.lower().translate(BREAKS).replace(BREAK, b" \xff ").split()


class WordHashes(dict):
    """Hashes of words; zero stands for a break alone. ``clear`` keeps a worker small."""

    def __init__(self, seed: int):
        super().__init__({BREAK: 0})
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = 0 if word == BREAK else xxhash.xxh3_64_intdigest(word, self.seed) or 1
        self[word] = found
        return found


ENCODED = "lang string, ids binary, word string, hash bigint, n bigint"


def encoded(docs: DataFrame, seed: int) -> DataFrame:
    """From ``lang`` and ``text``: a row ``(lang, ids)`` per text, and rows ``(lang, word, hash, n)``."""
    schema = pa.schema([("lang", pa.string()), ("ids", pa.binary()), ("word", pa.string()), ("hash", pa.int64()), ("n", pa.int64())])

    def read(batches):
        known, counts = WordHashes(seed), {}

        def counted():
            for lang, own in counts.items():
                own.pop(BREAK, None)
                words, n = list(own), len(own)
                hashes = np.fromiter(map(known.__getitem__, words), np.uint64, n).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.nulls(n, pa.binary()), pa.array(
                    words, pa.binary()).cast(pa.string()), pa.array(hashes), pa.array(list(own.values()), pa.int64())], schema=schema)
            counts.clear()

        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(start, TEXTS)
                langs, ids = batch.column(0).to_pylist(), []
                for lang, raw in zip(langs, raw_texts(batch.column(1))):
                    words = words_of(raw)
                    ids.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)).tobytes())
                    counts.setdefault(lang, Counter()).update(words)
                    if sum(map(len, counts.values())) > COUNTED:
                        yield from counted()
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ids, pa.binary()), pa.nulls(n, pa.string()),
                                                  pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema)
        yield from counted()

    return docs.mapInArrow(read, ENCODED)


def streams(batches, marked: bool = False) -> Iterator[tuple]:
    """The texts ``(lang, ids)`` of each batch end to end, in chunks of whole texts of one group.

    Zeros stand after every text, enough that no window reaches into the next. ``marked`` adds the
    mark of every position's text, which the text's words alone decide.
    """
    gap = np.zeros(LONGEST - 1, np.uint64)
    for batch in batches:
        held: dict[str, list[np.ndarray]] = {}
        marks: dict[str, list[np.ndarray]] = {}
        sizes: Counter = Counter()

        def chunk(lang: str) -> tuple:
            out = lang, np.concatenate(held.pop(lang))
            return (*out, np.concatenate(marks.pop(lang))) if marked else out

        for lang, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = ids.as_py()
            own = np.frombuffer(raw, np.uint64)
            held.setdefault(lang, []).extend((own, gap))
            if marked:
                marks.setdefault(lang, []).append(np.full(len(own) + len(gap), xxhash.xxh3_64_intdigest(raw) % (1 << MARK_BITS), np.uint8))
            sizes[lang] += len(own) + len(gap)
            if sizes[lang] >= POSITIONS:
                del sizes[lang]
                yield chunk(lang)
        for lang in list(held):
            yield chunk(lang)
        pa.default_memory_pool().release_unused()


def codes(lang: str, ids: np.ndarray, k: int) -> np.ndarray:
    """The code of the ``k`` words from each position on; the last ``LONGEST - 1`` have none."""
    n = len(ids) - LONGEST + 1
    total = np.full(n, xxhash.xxh3_64_intdigest(lang.encode(), k), np.uint64)
    for place in range(k):
        total += mix(ids[place:place + n] + np.uint64(place)) * PLACES[place]
    return mix(total)


def full(ids: np.ndarray, k: int) -> np.ndarray:
    """Where ``k`` words follow each other without a break."""
    n = len(ids) - LONGEST + 1
    ok = ids[:n] != 0
    for place in range(1, k):
        ok &= ids[place:place + n] != 0
    return ok


#: Where a mark enters a code: it moves both of the code's bits.
MARKED = (1 << 10) + (1 << 42)


def bitmap(frequent: DataFrame) -> np.ndarray:
    """Two bits for each ``code``; the driver gets 64 of them a row, ``BITS / 64`` rows at most."""
    bit = F.pmod("half", F.lit(BITS))
    rows = frequent.select(F.explode(F.array("code", F.shiftrightunsigned("code", 32))).alias("half")).select(bit.alias("bit")).select(F.shiftright("bit", 6).alias("at"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("bits"))
    rows = rows.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)  # little-endian: bit i is in byte i // 8


def on(bits: np.ndarray, own: np.ndarray) -> np.ndarray:
    def is_set(slot: np.ndarray) -> np.ndarray:
        slot = slot.view(np.int64) & (8 * len(bits) - 1)
        return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)

    found = is_set(own)
    found[found] = is_set(own[found] >> np.uint64(32))
    return found


def windows(lang: str, ids: np.ndarray, k: int, below: np.ndarray) -> np.ndarray:
    """Where ``k`` words follow each other that may be frequent: both windows of ``k - 1`` words are on ``below``."""
    short = full(ids, k - 1)
    short[short] = on(below, codes(lang, ids, k - 1)[short])
    return short & np.append(short[1:], False) & full(ids, k)


def frequent_codes(texts: DataFrame, k: int, below, least: int) -> DataFrame:
    """``(code, n, mark)`` of the windows of ``k`` words that may be frequent. ``below``: the bitmap for ``k - 1``."""
    def find(batches):
        held, size = [], 0

        def summed():
            own, marks = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(own)
            own = own[order]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else order
            n = np.diff(np.append(first, len(own)))
            return pa.RecordBatch.from_arrays([pa.array(own[first].view(np.int64)), pa.array(n << MARK_BITS | marks[order[first]])], ["code", "tally"])

        for lang, ids, marks in streams(batches, marked=True):
            ok = windows(lang, ids, k, below.value)
            held.append((codes(lang, ids, k)[ok], marks[:len(ok)][ok]))
            size += len(held[-1][0])
            if size >= HELD:
                yield summed()
                size = 0
        if held:
            yield summed()

    found = texts.mapInArrow(find, "code bigint, tally bigint").groupBy("code").agg(
        F.sum(F.shiftright("tally", MARK_BITS)).alias("n"), F.min(F.col("tally").bitwiseAND((1 << MARK_BITS) - 1)).alias("mark"))
    return materialise(found.where(F.col("n") >= least), "codes")


def candidates(texts: DataFrame, below: dict, wanted: dict, marked: bool) -> DataFrame:
    """The different windows ``(lang, w0 ... w3, code)`` on set bits; zeros fill shorter ones.

    ``wanted`` has the bitmap of the codes of each length or, if ``marked``, of codes and marks together:
    then a window is given by the texts of its code's mark only.
    """
    def find(batches):
        seen = np.empty(0, np.uint64)
        for lang, ids, marks in streams(batches, marked=True):
            for k, bits in wanted.items():
                ok, own = windows(lang, ids, k, below[k - 1].value), codes(lang, ids, k)
                keys = own ^ marks[:len(own)] * np.uint64(MARKED) if marked else own
                ok[ok] = on(bits.value, keys[ok])
                at = np.flatnonzero(ok)
                if marked:  # one of each is enough, and what two phrases share is seen later
                    at = at[np.unique(own[at], return_index=True)[1]]
                    # what this task has given already; forgotten when it grows large
                    place_ = np.searchsorted(seen, own[at])
                    at = at[np.append(seen, 0)[place_] != own[at]] if len(seen) else at
                    seen = np.sort(np.concatenate([seen if len(seen) < SEEN else seen[:0], own[at]]), kind="stable")
                columns = [pa.array((ids[at + i] if i < k else np.zeros(len(at), np.uint64)).view(np.int64)) for i in range(LONGEST)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), *columns, pa.array(own[at].view(np.int64))], ["lang", *WORDS, "code"])

    return texts.mapInArrow(find, "lang string, " + ", ".join(f"{w} bigint" for w in WORDS) + ", code bigint").distinct()


def digits(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two symbols of each word number; zeros for zero."""
    some = numbers > 0
    return np.where(some, (numbers - 1) // SYMBOLS + 1, 0), np.where(some, (numbers - 1) % SYMBOLS + 1, 0)


@dataclass
class Trie:
    """``symbols``: ascending word hashes, ``ranks`` their numbers from 1; ``roots``: state by group."""

    symbols: np.ndarray
    ranks: np.ndarray
    base: np.ndarray
    check: np.ndarray
    roots: dict[str, int]

    def read(self, ids: np.ndarray) -> np.ndarray:
        """The symbol of every word, 0 where the trie has none."""
        at = np.minimum(np.searchsorted(self.symbols, ids), len(self.symbols) - 1)
        return np.where(self.symbols[at] == ids, self.ranks[at], 0)

    def step(self, states: np.ndarray | int, symbols: np.ndarray) -> np.ndarray:
        to = np.clip(self.base[states] + symbols, 0, len(self.check) - 1)
        return np.where((symbols > 0) & (self.check[to] == states), to, 0)

    def reached(self, lang: str, ids: np.ndarray) -> list[np.ndarray]:
        """The states after two words or more, from every position; zero where there is none."""
        return self.advance(lang, *digits(self.read(ids)))

    def advance(self, lang: str, first: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
        """As ``reached``, from the two symbols of each word."""
        root, out = self.roots.get(lang), []
        if root is None:
            return out
        at = np.flatnonzero(first[:len(first) - LONGEST + 1])
        states = self.step(self.step(root, first[at]), second[at])
        for level in range(1, LONGEST):
            at, states = at[states > 0], states[states > 0]
            states = self.step(self.step(states, first[at + level]), second[at + level])
            out.append(states.astype(np.int32))
        return out


@dataclass
class Tries:
    """Some tries and their common alphabet: ``steps`` has the two symbols of each word in each trie, none for the last place."""

    symbols: np.ndarray
    steps: list[tuple[np.ndarray, np.ndarray]]
    members: list[Trie]

    @classmethod
    def of(cls, members: list[Trie]) -> Tries:
        symbols, steps = np.unique(np.concatenate([t.symbols for t in members])), []
        for t in members:
            ranks = np.zeros(len(symbols) + 1, np.int32)
            ranks[np.searchsorted(symbols, t.symbols)] = t.ranks
            steps.append(digits(ranks))
        return cls(symbols, steps, members)

    def reached(self, lang: str, ids: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Each trie's number and the states it reaches. Every word is looked up once for all."""
        at = np.minimum(np.searchsorted(self.symbols, ids), len(self.symbols) - 1)
        at = np.where(self.symbols[at] == ids, at, len(self.symbols))
        for i, (trie, (first, second)) in enumerate(zip(self.members, self.steps)):
            yield i, trie.advance(lang, first[at], second[at])


def place(symbols: np.ndarray, starts: np.ndarray, reserved: int) -> tuple[np.ndarray, int]:
    """A base for each list of ascending symbols, so that no two lists use one place; and the places' number.
    List ``i`` begins at ``starts[i]`` of ``symbols``, where the one before ends.

    Long lists lie one after the other; short ones go where they fit among them, all of one length at
    a time, at places drawn at random until no two meet; lists of one symbol fill what is free.
    """
    sizes = np.diff(np.append(starts, len(symbols)))
    base, rng = np.zeros(len(starts), np.int64), np.random.default_rng(3)
    long = np.flatnonzero(sizes > SHORT)
    room = reserved + int((symbols[starts[long] + sizes[long] - 1] - symbols[starts[long]] + 1).sum())
    short = np.flatnonzero((sizes > 1) & (sizes <= SHORT))
    limit = max(room, reserved + 4 * int(sizes[short].sum()) + SYMBOLS)
    used = np.zeros(limit + SYMBOLS + len(starts), bool)
    used[:reserved], at = True, reserved
    for i in long:
        own = symbols[starts[i]:starts[i] + sizes[i]]
        far = own - own[0]
        used[at + far] = True
        base[i], at = at - own[0], at + far[-1] + 1
    for size in range(SHORT, 1, -1):
        left = short[sizes[short] == size]
        if not len(left):
            continue
        own = symbols[starts[left][:, None] + np.arange(size)]
        far, rounds = own - own[:, :1], 0
        while len(left):
            rounds += 1
            if rounds % 16 == 0:  # crowded
                limit += limit // 2
                used = np.append(used, np.zeros(limit // 2 + 1, bool))
            to = rng.integers(reserved, limit, len(left))
            slots = to[:, None] + far
            free = np.flatnonzero(~used[slots].any(axis=1))
            # of lists that want one place, the first gets it
            flat = slots[free].ravel()
            wins = np.zeros(len(flat), bool)
            wins[np.unique(flat, return_index=True)[1]] = True
            free = free[wins.reshape(-1, size).all(axis=1)]
            used[slots[free]] = True
            base[left[free]] = to[free] - own[free, 0]
            keep = np.ones(len(left), bool)
            keep[free] = False
            left, own, far = left[keep], own[keep], far[keep]
    single = np.flatnonzero(sizes == 1)
    free = np.flatnonzero(~used)[:len(single)]
    base[single] = free - symbols[starts[single]]
    used[free] = True
    return base, int(np.flatnonzero(used).max(initial=0)) + 2  # the last place stays free


def build(langs: pa.Array, words: np.ndarray) -> tuple[Trie, np.ndarray]:
    """The trie of phrases (rows of word hashes, zeros at the end), and the state of each phrase."""
    symbols, inverse, times = np.unique(words, return_inverse=True, return_counts=True)
    inverse = inverse.reshape(words.shape)
    blank = int(len(symbols) > 0 and symbols[0] == 0)
    # the most frequent words get the smallest numbers, which lie close together
    ranks = np.zeros(len(symbols), np.int64)
    order = np.argsort(-times[blank:], kind="stable") + blank
    ranks[order] = np.arange(1, len(order) + 1)
    steps = np.stack(digits(ranks[inverse]), axis=2).reshape(len(words), -1)
    groups = langs.dictionary_encode()
    names = groups.dictionary.to_pylist()
    number = {lang: i for i, lang in enumerate(names)}
    # nodes by number: the groups' roots first, then level by level
    at, nodes = groups.indices.to_numpy().astype(np.int64), len(names)
    parents, via, last = [np.full(nodes, -1)], [np.zeros(nodes, np.int64)], at.copy()
    width = int(steps.max(initial=0)) + 1
    live = np.arange(len(words))
    for level in range(steps.shape[1]):
        live = live[steps[live, level] > 0]
        keys, which = np.unique(at[live] * width + steps[live, level], return_inverse=True)
        at[live] = nodes + which
        parents.append(keys // width)
        via.append(keys % width)
        nodes += len(keys)
        last[live] = at[live]
    parents, via = np.concatenate(parents), np.concatenate(via)
    inner = np.arange(len(names), nodes)
    inner = inner[np.lexsort((via[inner], parents[inner]))]
    owner, first = np.unique(parents[inner], return_index=True)
    reserved = len(names) + 1
    base, size = place(via[inner], first, reserved)
    of_node = np.zeros(nodes, np.int64)
    of_node[owner] = base
    state = np.zeros(nodes, np.int64)
    state[:len(names)] = np.arange(1, reserved)
    state[inner] = of_node[parents[inner]] + via[inner]
    bases, check = np.zeros(size, np.int64), np.full(size, -1)
    bases[state], check[state[inner]] = of_node, state[parents[inner]]
    return Trie(symbols[blank:], ranks[blank:], bases.astype(np.int32), check.astype(np.int32), {x: i + 1 for x, i in number.items()}), state[last]


TRIES = ("part int, state int, lang string, " + ", ".join(f"{w} bigint" for w in WORDS)
         + ", code bigint, symbols binary, ranks binary, base binary, checks binary, langs array<string>")


def tries(phrases: DataFrame, size: int) -> tuple[DataFrame, int]:
    """A row per trie with its arrays, and a row per phrase with its trie and state."""
    parts = max(1, -(-phrases.count() // size))
    dealt = phrases.withColumn("part", F.pmod(F.xxhash64("lang", *WORDS), F.lit(parts)).cast("int"))
    names = [x.split()[0] for x in TRIES.split(", ")]

    def make(own: pa.Table) -> pa.Table:
        words = np.stack([own.column(w).to_numpy().view(np.uint64) for w in WORDS], 1)
        trie, states = build(own.column("lang").combine_chunks(), words)
        n, part = len(own), own.column("part")[0].as_py()
        arrays = [trie.symbols.tobytes(), trie.ranks.astype(np.int32).tobytes(), trie.base.tobytes(), trie.check.tobytes()]
        kinds = [pa.binary()] * 4 + [pa.list_(pa.string())]
        head = pa.table([pa.array([part], pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), *[pa.nulls(1, pa.int64()) for _ in (*WORDS, "code")],
                         *[pa.array([v], k) for v, k in zip([*arrays, list(trie.roots)], kinds)]], names)
        rows = pa.table([pa.array(np.full(n, part), pa.int32()), pa.array(states.astype(np.int32)), own.column("lang"), *[own.column(w) for w in (*WORDS, "code")],
                         *[pa.nulls(n, k) for k in kinds]], names)
        return pa.concat_tables([head.cast(rows.schema), rows])

    return materialise(dealt.groupBy("part").applyInArrow(make, TRIES), "tries"), parts


def fetched(row) -> Trie:
    small = [np.frombuffer(row[c], np.int32) for c in ("ranks", "base", "checks")]
    return Trie(np.frombuffer(row.symbols, np.uint64), *small, {x: i + 1 for i, x in enumerate(row.langs)})


def task_counts(texts: DataFrame, tries_) -> DataFrame:
    """``(member, state, n)``: how often each task reaches each state of the broadcast tries.

    A task per core, however many files the texts lie in: the rows are at most cores x states, and
    a task's counts have a fixed size whatever it reads.
    """
    def count(batches):
        own = tries_.value
        counts = [np.zeros(len(t.base), np.int64) for t in own.members]
        held: list[list[np.ndarray]] = [[] for _ in counts]

        def settle(i: int) -> None:
            counts[i] += np.bincount(np.concatenate([np.zeros(0, np.int32), *held[i]]), minlength=len(counts[i]))
            held[i].clear()

        for lang, ids in streams(batches):
            for i, states in own.reached(lang, ids):
                held[i] += states
                if sum(map(len, held[i])) * len(held) > HELD:
                    settle(i)
        for i, sums in enumerate(counts):
            settle(i)
            sums[0] = 0
            met = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), i, np.int32)), pa.array(met.astype(np.int32)), pa.array(sums[met])], ["member", "state", "n"])

    return texts.coalesce(texts.sparkSession.sparkContext.defaultParallelism).mapInArrow(count, "member int, state int, n bigint")


def counted(texts: DataFrame, tries_) -> DataFrame:
    """``(member, state, n)``: how often each state of the broadcast tries is reached."""
    return task_counts(texts, tries_).groupBy("member", "state").agg(F.sum("n").alias("n"))


def count_candidates(texts: DataFrame, wanted: DataFrame, trie_size: int) -> DataFrame:
    """``(lang, w0 ... w3, code, f)``: the exact counts of the phrases ``wanted``."""
    context = texts.sparkSession.sparkContext
    found, parts = tries(wanted, trie_size)
    numbers, of_pass = list(range(parts)), []
    heads = found.where("symbols is not null")
    for start in range(0, parts, TOGETHER):  # a pass each, with these tries on the driver and in the tasks
        here = numbers[start:start + TOGETHER]
        rows = sorted(heads.where(F.col("part").isin(here)).collect(), key=lambda r: r["part"])
        if not rows:
            continue
        own = context.broadcast(Tries.of([fetched(r) for r in rows]))
        part = F.get(F.array(*[F.lit(r["part"]) for r in rows]), F.col("member"))
        of_pass.append(materialise(counted(texts, own).select(part.alias("part"), "state", F.col("n").alias("f")), "counts"))
        own.unpersist()
    named = found.where("state is not null").select("part", "state", "lang", *WORDS, "code")
    if not of_pass:
        return named.select("lang", *WORDS, "code", F.lit(0).cast("bigint").alias("f")).where("false")
    counts = of_pass[0]
    for other in of_pass[1:]:
        counts = counts.union(other)
    return materialise(named.join(counts, ["part", "state"]).select("lang", *WORDS, "code", "f"), "phrases")


def count_phrases(texts: DataFrame, words: DataFrame, least: int, trie_size: int) -> DataFrame:
    """``(lang, w, f)`` of every phrase of 2 to 4 words that occurs ``least`` times; ``w``: its word hashes."""
    context = texts.sparkSession.sparkContext

    def single(batches):
        for batch in batches:
            hashes = batch.column(1).to_numpy().view(np.uint64)
            out = [codes(lang, np.append(h, np.zeros(LONGEST - 1, np.uint64)), 1)[0] for lang, h in zip(batch.column(0).to_pylist(), hashes)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(out, np.uint64).view(np.int64))], ["code"])

    frequent = words.where(F.col("f") >= least).select("lang", "hash").mapInArrow(single, "code bigint")
    below, wanted, every = {1: context.broadcast(bitmap(frequent))}, {}, None
    key = F.col("code").bitwiseXOR(F.col("mark") * F.lit(MARKED)).alias("code")
    for k in range(2, LONGEST + 1):
        own = frequent_codes(texts, k, below[k - 1], least)
        wanted[k] = context.broadcast(bitmap(own.select(key)))
        every = own if every is None else every.union(own)
        if k < LONGEST:
            below[k] = context.broadcast(bitmap(own.select("code")))
    given = candidates(texts, below, wanted, marked=True)
    # what was on set bits by chance goes
    given = materialise(given.join(every.select("code").distinct(), "code", "left_semi").select("lang", *WORDS, "code"), "candidates")
    found = count_candidates(texts, given, trie_size)
    # a code is settled if its phrases make up its count; else there are more phrases with this code
    sums = found.groupBy("code").agg(F.sum("f").alias("f"))
    totals = every.groupBy("code").agg(F.sum("n").alias("n"))
    rest = materialise(totals.join(sums, "code", "left").where(F.coalesce("f", F.lit(0)) < F.col("n")).select("code"), "shared")
    if not rest.isEmpty():
        shared = context.broadcast(bitmap(rest))
        more = candidates(texts, below, {k: shared for k in wanted}, marked=False)
        more = more.join(rest, "code", "left_semi").join(given.select("lang", *WORDS), ["lang", *WORDS], "left_anti")
        found = found.union(count_candidates(texts, materialise(more.select("lang", *WORDS, "code"), "candidates"), trie_size))
        shared.unpersist()
    for bits in (*below.values(), *wanted.values()):
        bits.unpersist()
    return found.where(F.col("f") >= least).select("lang", F.filter(F.array(*WORDS), lambda w: w != 0).alias("w"), "f")


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Add the lowest-scoring cut ``(score, k, l, r)`` of each phrase, exact in decimals."""
    every = phrases.unionByName(words.select("lang", F.array("hash").alias("w"), "f"))
    cuts = phrases.select("lang", "w", "f", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("w", F.lit(1), F.col("k")).alias("w_l"), F.slice("w", F.col("k") + 1, F.size("w")).alias("w_r"))
    for side in "lr":
        cuts = cuts.join(every.select("lang", F.col("w").alias(f"w_{side}"), F.col("f").alias(side)), ["lang", f"w_{side}"])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(f as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    return cuts.withColumn("score", score).groupBy("lang", "w", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))


def absorbed(phrases: DataFrame) -> DataFrame:
    """``(lang, w, most)``: of phrases inside longer ones, the largest count of these."""
    longer = phrases.where(F.size("w") > 2)
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))))
    return longer.select("lang", "f", F.explode(inside).alias("w")).groupBy("lang", "w").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", least: int = LEAST, top: int = TOP,
                 trie_size: int = TRIE, seed: int = 0) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each group."""
    docs = docs.select(F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    for seed in itertools.count(seed):
        read = materialise(encoded(docs, seed), "encoded")
        words = materialise(read.where("word is not null").groupBy("lang", "word", "hash").agg(F.sum("n").alias("f")), "words")
        # two words of a group with one hash: with another seed they have two
        if words.groupBy("lang", "hash").count().where("count > 1").isEmpty():
            break
    phrases = count_phrases(read.where("ids is not null").select("lang", "ids"), words, least, trie_size)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    kept = scored(phrases, words.where(F.col("f") >= least)).join(absorbed(phrases), ["lang", "w"], "left").where(
        F.col("most").isNull() | (100 * F.col("most") < 80 * F.col("f")))
    # the words' texts, in their order
    each = kept.select("lang", "w", "f", "cut", F.posexplode("w").alias("i", "hash")).join(words.select("lang", "hash", "word"), ["lang", "hash"])
    texts = each.groupBy("lang", "w", "f", "cut").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = [F.desc("cut.score"), F.desc("f"), F.asc("phrase")]
    salted = materialise(texts.withColumn("salt", F.pmod(F.xxhash64("w"), F.lit(parallelism(docs.sparkSession)))), "scored")
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", "rank", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
