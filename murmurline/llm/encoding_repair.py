"""Text that was decoded with the wrong character encoding: which records, and what they said.

A multinomial (softmax) classifier over hashed byte bigrams tells, for each word with a character
beyond ASCII, by which exact chain of encodings it was garbled, if at all.  It is trained here on the
words of the collection itself and on the same words garbled synthetically by every chain.  Its most
probable class decides.  The prediction is then inverted and verified: the characters must map back to
bytes, the bytes must decode strictly, and the result must consist of characters the collection uses;
otherwise the word counts as clean.

Two rules stand beside it.  A replacement character shows lost characters by itself.  A single-byte chain
decodes any bytes, so its words must also make sense by the collection's words and letter pairs, and they
count by the stretch they stand in, whose words between and beside the named ones belong to it.

Nothing is fitted on a sample.  Every word of every text is counted; all words that count as clean are the
vocabulary and, garbled by every chain, the training examples, which stay in blocks on the executors and send
only their gradients.  The vocabulary stays a table: a text that may hold a single-byte chain fetches the counts
of its own words.  The driver receives characters and pairs of characters, which Unicode bounds, and the weights.
Every document is classified, over its whole text.

Defined results: NULL and empty texts, and texts of ASCII only, are never garbled; a text with a
replacement character is garbled and, as that character stood for lost bytes, not restorable; repeated
ids give repeated rows; an empty table gives no row; a collection without words to learn from finds
replacement characters only.  The text is restored stretch by stretch, clean words stay as they are.
"""

from __future__ import annotations

import operator
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurline.session import cut_lineage

WORDS_A_PART = 500  # clean words whose examples one task holds
EXAMPLES_A_BLOCK = 2048
UNIT = 2.0**40  # gradients are added up as whole numbers of 1 / UNIT, so that their order doesn't matter
FEATURES = 3 << 10
LOST = "�"

#: (name, [(wrong, right), ...]): bytes of ``right`` were read as ``wrong``, in this order.
CHAINS: tuple[tuple[str, tuple[tuple[str, str], ...]], ...] = (
    ("utf8_as_cp1252", (("cp1252", "utf-8"),)),
    ("utf8_as_latin1", (("latin1", "utf-8"),)),
    ("utf8_as_cp1250", (("cp1250", "utf-8"),)),
    ("utf8_as_cp1251", (("cp1251", "utf-8"),)),
    ("utf8_as_cp437", (("cp437", "utf-8"),)),
    ("utf8_as_cp850", (("cp850", "utf-8"),)),
    ("utf8_as_cp866", (("cp866", "utf-8"),)),
    ("utf8_as_mac", (("mac_roman", "utf-8"),)),
    ("utf8_twice_as_cp1252", (("cp1252", "utf-8"), ("cp1252", "utf-8"))),
    ("utf8_twice_as_latin1", (("latin1", "utf-8"), ("latin1", "utf-8"))),
    ("cp1251_as_cp1252", (("cp1252", "cp1251"),)),
    ("koi8_as_cp1251", (("cp1251", "koi8-r"),)),
    ("cp1250_as_cp1252", (("cp1252", "cp1250"),)),
)
CLEAN = len(CHAINS)
WORD = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")
RUN = re.compile(r"[^\x00-\x7f]+")


def _table(encoding: str) -> tuple[dict[int, str], dict[str, int]]:
    """Byte to character and back; a byte without a character is the control of its number, as browsers do."""
    to = {}
    for b in range(256):
        try:
            to[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            to[b] = chr(b)
    back: dict[str, int] = {}
    for b, ch in to.items():
        back.setdefault(ch, b)
    return to, back


_TABLES = {e: _table(e) for e in {wrong for _, steps in CHAINS for wrong, _ in steps}}


def garble(text: str, chain: int) -> str | None:
    """``text`` as it looks after the chain; None if its characters don't fit the right encoding."""
    for wrong, right in CHAINS[chain][1]:
        try:
            raw = text.encode(right)
        except UnicodeEncodeError:
            return None
        text = "".join(_TABLES[wrong][0][b] for b in raw)
    return text


def invert(text: str, chain: int) -> str | None:
    """The text before the chain, or None unless every step maps back and decodes strictly."""
    for wrong, right in reversed(CHAINS[chain][1]):
        back = _TABLES[wrong][1]
        try:
            text = bytes([back[ch] for ch in text]).decode(right)
        except (KeyError, UnicodeDecodeError):
            return None
    return text


def _single_byte(chain: int) -> bool:
    return all(right != "utf-8" for _, right in CHAINS[chain][1])


SINGLE_BYTE = tuple(c for c in range(CLEAN) if _single_byte(c))


class Bigrams:
    """Sparse rows of hashed byte bigram counts (root scale) of whole words: neighbouring bytes, and bytes with one between them.

    In UTF-8 the latter are the last bytes of neighbouring characters beyond ASCII.
    """

    def __init__(self, words: list[str]):
        at, counts, starts, total = [], [], [0], 0
        for w in words:
            raw = b"\x02" + re.sub(r"[0-9]", "0", w).encode("utf-8", "replace") + b"\x03"
            seen: Counter = Counter()
            for gap in (1, 2):
                seen.update((gap * 1000003 + x * 257 + y) * 2654435761 // 128 % FEATURES for x, y in zip(raw, raw[gap:]))
            at.extend(seen)
            counts.extend(seen.values())
            total += len(seen)
            starts.append(total)
        self.at, self.starts = np.array(at, np.int64), np.array(starts[:-1], np.int64)
        self.value = np.sqrt(np.array(counts, np.float32))[:, None]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.at] * self.value, self.starts, axis=0)


def _core(word: str) -> str:
    """Without what surrounds the letters, in small letters."""
    return re.sub(r"^[\W\d_]+|[\W\d_]+$", "", word).lower()


def _letter_pairs(vocabulary: Iterable[str]) -> Counter:
    """How many of the words hold each pair of neighbouring characters, their edges included, as often as it stands there."""
    pairs: Counter = Counter()
    for w in vocabulary:
        pairs.update(a + b for a, b in zip(f" {w}", f"{w} "))
    return pairs


class Model:
    """Softmax weights, the characters the collection uses, the letter pairs of its words, and in how many documents each word occurs.

    Of the words, ``vocabulary`` need only hold those that the texts at hand ask for (``asked``).
    """

    def __init__(self, weights: np.ndarray, bias: np.ndarray, alphabet: frozenset[str], pairs: Counter, vocabulary: dict[str, int]):
        self.weights, self.bias, self.alphabet, self.pairs, self.vocabulary = weights, bias, alphabet, pairs, vocabulary

    def known(self, word: str) -> int:
        return self.vocabulary.get(_core(word), 0)

    def confirms(self, word: str, restored: str) -> bool:
        """Whether the collection has ``restored`` as a word, and far more often than what stands there."""
        return self.known(restored) > 3 * self.known(word)

    def reads_better(self, word: str, restored: str, by: float = 1.5) -> bool:
        """Whether the letter pairs of ``restored``, each seen, are those of the collection's words much rather than the word's own."""

        def mean(w: str) -> tuple[float, int]:
            seen = [self.pairs[a + b] for a, b in zip(f" {w}", f"{w} ")]
            return float(np.mean(np.log(np.array(seen) + 0.5))), min(seen)

        (ours, least), (theirs, _) = mean(_core(restored)), mean(word.strip(".,;:!?()\"'").lower())
        return least >= 2 and ours - theirs >= by

    def probabilities(self, words: list[str]) -> np.ndarray:
        z = Bigrams(words).times(self.weights) + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


#: Features and values example by example, where each example starts, labels; then examples and values feature by
#: feature, the features in order, where each of them starts.
Block = tuple[np.ndarray, ...]


def _blocks(examples: Iterable[tuple[str, int]]) -> Iterator[Block]:
    rows = sorted(tuple(e) for e in examples)
    for at in range(0, len(rows), EXAMPLES_A_BLOCK):
        words, labels = zip(*rows[at : at + EXAMPLES_A_BLOCK])
        x = Bigrams(list(words))
        order = np.argsort(x.at, kind="stable")
        features, first = np.unique(x.at[order], return_index=True)
        example, value = np.repeat(np.arange(len(words)), np.diff(np.append(x.starts, len(x.at)))), x.value[:, 0]
        yield x.at.astype(np.int16), value, x.starts, np.array(labels, np.int8), example[order].astype(np.int16), value[order], features, first


def _slope(blocks: Iterable[Block], w: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The blocks' gradient of the loss by the weights and, in the last row, by the bias, in whole numbers of 1 / UNIT."""
    total = np.zeros((FEATURES + 1, len(b)), np.int64)
    for at, value, starts, label, example, again, features, first in blocks:
        z = np.add.reduceat(w[at] * value[:, None], starts, axis=0) + b
        z = np.exp(z - z.max(axis=1, keepdims=True))
        g = z / z.sum(axis=1, keepdims=True)
        g[np.arange(len(label)), label] -= 1.0
        g *= weight[label][:, None]
        total[features] += np.rint(np.add.reduceat(g[example] * again[:, None], first, axis=0) * UNIT).astype(np.int64)
        total[-1] += np.rint(g.sum(axis=0) * UNIT).astype(np.int64)
    return total


def _fit(slope: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], held: np.ndarray, rounds: int = 80, rate: float = 0.1, decay: float = 3e-5) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by full-batch Adam; classes weigh the same, whatever number of examples each has (``held``)."""
    classes = len(held)
    w, b = np.zeros((FEATURES, classes), np.float32), np.zeros(classes, np.float32)
    weight = (1.0 / np.maximum(held, 1) / classes).astype(np.float32)
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, rounds + 1):
        g = (slope(w, b, weight) / UNIT).astype(np.float32)
        for k, (p, grad) in enumerate(((w, g[:-1] + decay * w), (b, g[-1]))):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            p -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w, b


def _held(blocks: Iterable[Block]) -> np.ndarray:
    return sum((np.bincount(b[3], minlength=CLEAN + 1) for b in blocks), np.zeros(CLEAN + 1, np.int64))


def _fit_spread(blocks: RDD) -> tuple[np.ndarray, np.ndarray]:
    """``_fit`` over blocks that stay on the executors; a round sends the weights there and the sum of the gradients back."""
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)

    def slope(w: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
        sent = blocks.context.broadcast((w, b, weight))
        total = blocks.mapPartitions(lambda part: [_slope(part, *sent.value)]).treeReduce(operator.add)
        sent.destroy()
        return total

    fitted = _fit(slope, blocks.mapPartitions(lambda part: [_held(part)]).treeReduce(operator.add))
    blocks.unpersist()
    return fitted


def alphabet_of(df: DataFrame, text: str, least: int = 3) -> frozenset[str]:
    """The characters beyond ASCII that at least ``least`` texts of the collection use.

    Counted over all texts; the driver receives one row for each such character, which Unicode bounds.
    """
    beyond = F.regexp_replace(F.col(text), r"[\x00-\x7F]+", "")
    chars = df.select(F.explode(F.array_distinct(F.split(beyond, ""))).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return frozenset(r["c"] for r in chars.filter((F.col("n") >= least) & (F.length("c") > 0)).collect()) - {LOST}


def _script(word: str) -> str:
    return unicodedata.name(RUN.findall(word)[0][0], "?").split()[0]


def _capitals(word: str) -> str | None:
    """The word in a headline of capitals; garbled by a single-byte chain, small Cyrillic letters are capitals and the other way round."""
    y = word.upper()
    return y if _script(word) != "CYRILLIC" and len(y) == len(word) and y != word else None


def _garbled(word: str, capitals: bool) -> Iterator[tuple[str, int]]:
    """The word garbled synthetically by every chain, each with the chain that undoes it.

    Several chains may give the same characters; the label is then the first chain that leads back to the word, so
    that what can't be told apart is not asked for.
    """
    for chain in range(CLEAN):
        if _single_byte(chain) and capitals:
            continue
        y = garble(word, chain)
        if y is None or y == word:
            continue
        if _single_byte(chain):
            label = chain if invert(y, chain) == word else None
        else:
            label = next((c for c in range(CLEAN) if not _single_byte(c) and _undone(y, c) == word), None)
        if label is not None:
            yield y, label


def examples(clean: list[str]) -> tuple[list[str], list[int]]:
    """Clean words and their capitals, and all of them garbled, unless that is a clean word itself; each with its label."""
    known = set(clean)
    capitals = sorted({y for w in clean if (y := _capitals(w)) is not None} - known)
    made = [(y, label) for words, large in ((clean, False), (capitals, True)) for w in words for y, label in _garbled(w, large) if y not in known]
    return [*clean, *capitals, *(y for y, _ in made)], [CLEAN] * (len(clean) + len(capitals)) + [label for _, label in made]


def spread_examples(clean: DataFrame) -> DataFrame:
    """(word, label): ``examples`` of a table of clean words."""

    def capitals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if rows := [y for w in pdf["word"] if (y := _capitals(w)) is not None]:
                yield pd.DataFrame({"word": rows})

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if rows := [e for w, large in zip(pdf["word"], pdf["large"]) for e in _garbled(w, large)]:
                yield pd.DataFrame(rows, columns=["word", "label"])

    words = clean.select("word")
    large = words.mapInPandas(capitals, "word string").distinct().join(words, "word", "left_anti")
    whole = words.withColumn("large", F.lit(False)).unionByName(large.withColumn("large", F.lit(True)))
    return whole.select("word", F.lit(CLEAN).alias("label")).unionByName(whole.mapInPandas(made, "word string, label int").join(words, "word", "left_anti"))


def _undone(word: str, chain: int) -> str:
    """``word`` with each run beyond ASCII that the chain can have made inverted."""
    return RUN.sub(lambda m: invert(m[0], chain) or m[0], word)


def _suspicious(word: str, alphabet: frozenset[str]) -> bool:
    """Whether a chain of UTF-8 can have made the word, or characters were lost."""
    if LOST in word or any(0x80 <= ord(c) < 0xA0 for c in word):
        return True
    for chain in range(CLEAN):
        if not _single_byte(chain):
            for run in RUN.findall(word):
                y = invert(run, chain)
                if y is not None and alphabet.issuperset(y):
                    return True
    return False


def _origins(word: str) -> list[str]:
    """The other words that a single-byte chain can have made this one of."""
    return sorted({_core(_undone(word, c)) for c in SINGLE_BYTE} - {_core(word), ""})


def train(documents: list[list[str]], alphabet: frozenset[str]) -> Model | None:
    """The model from the words beyond ASCII of documents held in memory; None if there is nothing to learn from."""
    held: Counter = Counter()
    for words in documents:
        held.update(set(words))
    clean = [w for w, n in held.items() if n >= 2 and not _suspicious(w, alphabet)]
    # A word that a single-byte chain made of one that is far commoner is not clean either.
    often: Counter = Counter()
    for w in clean:
        often[_core(w)] += held[w]
    often.pop("", None)
    clean = [w for w in clean if all(often[o] <= 3 * often[_core(w)] for o in _origins(w))]
    if not clean:
        return None
    blocks = list(_blocks(zip(*examples(clean))))
    weights, bias = _fit(lambda *at: _slope(blocks, *at), _held(blocks))
    vocabulary: Counter = Counter()
    for w in clean:
        vocabulary[_core(w)] += held[w]
    vocabulary.pop("", None)
    return Model(weights, bias, alphabet, _letter_pairs(vocabulary), dict(vocabulary))


def _inverted(word: str, chain: int, model: Model) -> str | None:
    """``word`` with the runs inverted that give characters of the collection, or None if there are none."""
    changed = False

    def back(match: re.Match) -> str:
        nonlocal changed
        y = invert(match[0], chain)
        if y is None or y == match[0] or not model.alphabet.issuperset(y):
            return match[0]
        changed = True
        return y

    restored = RUN.sub(back, word)
    return restored if changed else None


def _verified(word: str, chain: int, model: Model, predicted: bool = False) -> str | None:
    """``word`` with its garbled runs inverted, or None unless the inversion holds up; ``predicted``: the classifier names this chain."""
    restored = _inverted(word, chain, model)
    if restored is None:
        return None
    if _single_byte(chain):
        # Any byte decodes here, so the word itself must make sense: one of the collection's, or letters of one script, no capitals inside.
        if model.confirms(word, restored):
            return restored
        letters = [c for c in restored if c.isalpha()]
        scripts = {unicodedata.name(c, "?").split()[0] for c in letters}
        if len(letters) < 4 or len(scripts) != 1 or not all(c.islower() for c in letters[1:]):
            return None
        mostly = predicted and len("".join(RUN.findall(word))) >= 0.6 * len(letters)
        if not mostly and (model.known(word) or not model.reads_better(word, restored)):
            return None
    return restored


def _stretches(words: list[str], chain: int, named: set[str], weak: dict[str, str], repaired: dict[str, tuple[int, str]], model: Model) -> dict[str, tuple[int, str]]:
    """Words of the stretches that a single-byte chain garbled, with what they said.

    ``named`` are the words that the classifier gives this chain, ``weak`` those of them whose inversion holds up.  A
    stretch is consecutive words beyond ASCII, from one that is named to another, without one that is known as it
    stands or that the chain can't have made.  Of its different words at least three must hold up, or one that the
    collection has, and at least half of those with letters; a word that the collection has stands for itself in any case.
    """
    found: dict[str, tuple[int, str]] = {}
    stretch: dict[str, str] = {}

    def close() -> None:
        good = [w for w in stretch if w in weak]
        sure = [w for w in good if model.confirms(w, weak[w])]
        found.update({w: (chain, weak[w]) for w in sure})
        order = list(stretch)
        whole = order[: max(i for i, w in enumerate(order) if w in named) + 1]
        if (len(good) >= 3 or sure) and 2 * len(good) >= sum(any(c.isalpha() for c in w) for w in whole):
            found.update({w: (chain, stretch[w]) for w in whole if stretch[w] != w})
        stretch.clear()

    for w in words:
        run = [invert(r, chain) for r in RUN.findall(w)]
        fits = w not in repaired and not model.known(w) and all(r is not None and model.alphabet.issuperset(r) for r in run)
        if w in weak:
            stretch[w] = weak[w]
        elif fits and (stretch or w in named):
            stretch[w] = _undone(w, chain)
        elif stretch and any(c.isalpha() for c in w):
            close()
    if stretch:
        close()
    return found


def _agreed(use: dict[str, tuple[int, str]], model: Model) -> dict[str, tuple[int, str]]:
    """One chain for as many of a text's garbled words as it verifies; the rest keep their own."""
    left, agreed = dict(use), {}
    while left:
        options = {c: {w: y for w in left if (y := _verified(w, c, model)) is not None} for c in {c for c, _ in left.values()}}
        chain = max(options, key=lambda c: (len(options[c]), -c))
        for w, y in options[chain].items() or {w: left[w][1] for w in left if left[w][0] == chain}.items():
            agreed[w] = (chain, y)
            del left[w]
    return agreed


def top_chains(found: list[list[str]], model: Model | None) -> dict[str, int]:
    """The most probable chain of each of the texts' words that is not most probably clean."""
    distinct = sorted({w for ws in found for w in ws if LOST not in w})
    top: dict[str, int] = {}
    for at in range(0, len(distinct) if model is not None else 0, 4096):
        part = distinct[at : at + 4096]
        top.update((w, chain) for w, chain in zip(part, model.probabilities(part).argmax(axis=1).tolist()) if chain != CLEAN)
    return top


def asked(found: list[list[str]], top: dict[str, int], model: Model) -> list[list[str] | None]:
    """The words whose counts ``judge`` reads for each text; None if it reads none, as no single-byte chain can be found there."""
    single = {w for w, chain in top.items() if chain in SINGLE_BYTE and _inverted(w, chain, model) is not None}
    read = [set() if single.isdisjoint(ws) else {y for w in ws for y in (w, *(_inverted(w, c, model) or w for c in SINGLE_BYTE))} for ws in found]
    return [sorted({_core(y) for y in ys} - {""}) if ys else None for ys in read]


def judge(texts: list[str], model: Model | None, found: list[list[str]] | None = None, top: dict[str, int] | None = None) -> list[tuple[bool, bool, str, str]]:
    """(garbled, restorable, chain names, restored text) of each text; ``found`` and ``top``: its words and ``top_chains``, if they are known.

    The most probable chain of each word decides; its inversion must hold up, or the word counts as clean.
    """
    found = [WORD.findall(t) for t in texts] if found is None else found
    top = top_chains(found, model) if top is None else top
    repaired: dict[str, tuple[int, str]] = {}
    named: dict[int, set[str]] = {c: set() for c in SINGLE_BYTE}
    weak: dict[int, dict[str, str]] = {c: {} for c in SINGLE_BYTE}
    for w in {w for ws in found for w in ws if w in top}:
        chain, y = top[w], _verified(w, top[w], model, predicted=True)
        if chain in SINGLE_BYTE:
            named[chain].add(w)
            if y is not None:
                weak[chain][w] = y
        elif y is not None:
            repaired[w] = (chain, y)
    out = []
    for text, words in zip(texts, found):
        lost = LOST in text
        use = {w: repaired[w] for w in words if w in repaired}
        for chain in SINGLE_BYTE:
            if any(w in weak[chain] for w in words):
                use = _stretches(words, chain, named[chain], weak[chain], repaired, model) | use
        if len({c for c, _ in use.values()}) > 1:
            use = _agreed(use, model)
        garbled = lost or bool(use)
        names = ",".join(sorted({CHAINS[c][0] for c, _ in use.values()} | ({"lossy"} if lost else set())))
        restored = WORD.sub(lambda m: use[m[0]][1] if m[0] in use else m[0], text) if use else text
        out.append((garbled, garbled and not lost, names, restored))
    return out


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n): in how many texts each word beyond ASCII occurs, over all texts."""
    words = F.array_distinct(F.filter(F.split(F.col(text), r"[ \t\r\n]+"), lambda w: w.rlike(r"[^\x00-\x7F]")))
    return df.filter(F.col(text).rlike(r"[^\x00-\x7F]")).select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def clean_words(counts: DataFrame, alphabet: frozenset[str]) -> DataFrame:
    """(word, core, n) of the words that ``train`` takes as clean."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(w, n, _core(w), _origins(w)) for w, n in zip(pdf["word"], pdf["n"]) if not _suspicious(w, alphabet)]
            if rows:
                yield pd.DataFrame(rows, columns=["word", "n", "core", "origins"])

    marked = cut_lineage(counts.filter("n >= 2").mapInPandas(mark, "word string, n long, core string, origins array<string>"))
    often = marked.filter("core <> ''").groupBy("core").agg(F.sum("n").alias("often"))
    rivals = marked.select("word", F.explode("origins").alias("core")).join(often, "core").groupBy("word").agg(F.max("often").alias("rival"))
    kept = marked.join(often, "core", "left").join(rivals, "word", "left").filter("coalesce(rival, 0) <= 3 * coalesce(often, 0)")
    return cut_lineage(kept.select("word", "core", "n"))


def fit(df: DataFrame, text: str) -> tuple[Model, DataFrame] | None:
    """The model, without its vocabulary, and the vocabulary (core, n), both of all texts; None if there is nothing to learn from."""
    alphabet = alphabet_of(df, text)
    clean = clean_words(word_counts(df, text), alphabet)
    size = clean.count()
    if not size:
        return None
    vocabulary = clean.filter("core <> ''").groupBy("core").agg(F.sum("n").alias("n"))

    def count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(list(_letter_pairs(pdf["core"]).items()), columns=["pair", "n"])

    # One row for each pair of characters that are neighbours in a word.
    pairs = vocabulary.select("core").mapInPandas(count_pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    weights, bias = _fit_spread(spread_examples(clean).repartition(-(-size // WORDS_A_PART), "word").rdd.mapPartitions(_blocks))
    return Model(weights, bias, alphabet, Counter({r["pair"]: r["n"] for r in pairs.collect()}), {}), vocabulary


def garbled_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, restorable boolean, chain string, restored string): every row whose text is garbled anywhere."""
    fitted = fit(df, text)
    model, vocabulary = fitted or (None, None)
    kind = dict(df.dtypes)[key]
    found = ["key", "restorable", "chain", "restored"]
    schema = f"key {kind}, restorable boolean, chain string, restored string"

    def table(keys: np.ndarray, judged: list[tuple[bool, bool, str, str]]) -> pd.DataFrame:
        out = pd.DataFrame(judged, columns=["garbled", *found[1:]])
        out.insert(0, "key", keys)
        return out

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                texts = part["t"].tolist()
                words = [WORD.findall(t) for t in texts]
                top = top_chains(words, model)
                asks = [None] * len(texts) if model is None else asked(words, top, model)
                # A text that asks for counts is judged when it has them.
                now = [i for i, a in enumerate(asks) if a is None]
                judged = dict(zip(now, judge([texts[i] for i in now], model, [words[i] for i in now], top)))
                out = table(part["k"].to_numpy(), [judged.get(i, (True, False, "", t)) for i, t in enumerate(texts)])
                out["asks"] = asks
                yield out.loc[out["garbled"], [*found, "asks"]]

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                counts = {w: n for words, ns in zip(part["words"], part["ns"]) if words is not None for w, n in zip(words, ns)}
                out = table(part["key"].to_numpy(), judge(part["t"].tolist(), Model(model.weights, model.bias, model.alphabet, model.pairs, counts)))
                yield out.loc[out["garbled"], found]

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("t").rlike(r"[^\x00-\x7F]"))
    scanned = rows.mapInPandas(scan, f"{schema}, asks array<string>")
    if model is None:
        return scanned.select(*found)
    scanned = cut_lineage(scanned.withColumn("row", F.monotonically_increasing_id()))
    asking = scanned.filter(F.col("asks").isNotNull()).select("row", "key", F.col("restored").alias("t"), "asks")
    counts = asking.select("row", F.explode("asks").alias("core")).join(vocabulary, "core").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("core", "n"))).alias("held"))
    told = asking.join(counts, "row", "left").select("key", "t", F.map_keys("held").alias("words"), F.map_values("held").alias("ns"))
    return scanned.filter(F.col("asks").isNull()).select(*found).unionByName(told.mapInPandas(rest, schema))
