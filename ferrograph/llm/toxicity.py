"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier trained on its posteriors.

Voters are lexicons and patterns that vote toxic, clean or not at all: small lists of abusive words, lists of words and word
beginnings that mark toxic rows in a bounded labelled sample (dealt out over several voters by hash), disguised spellings,
abuse next to a form of address, several different abusive words, shouting, politeness, and no mark at all.

The label model is a tree-augmented naive Bayes model of the votes, given the unseen class: expectation-maximisation over the
counts of all distinct vote patterns in the corpus estimates each voter's accuracy, and pairs of voters that depend on each
other given the class are joined in a maximum spanning tree, so that what two of them share counts once. The labelled sample
says which class is which: its votes, scaled to ``SEED_SHARE`` of the corpus, are counted with their labels in every step, so
voters begin with their accuracies on the sample and keep them as a prior. A voter that doesn't vote says nothing, as lexicons
that don't know a word aren't evidence against it. The model's posteriors are
the soft labels for a logistic regression over hashed words and word beginnings; an L1 step leaves a weight only to features
that tell something. The classifier scores every document over its whole text.

Bounds: the lexicons are induced from at most ``MAX_LABELLED`` labelled rows, and the classifier is fitted on at most
``MAX_TRAIN_ROWS`` documents of each class, chosen by the hash of their text. Counts of vote patterns cover all documents.

Defined cases: a null or empty text has probability 0 and isn't toxic. Rows with the same id are judged each by itself.
Without labels only the fixed lexicons and patterns vote, and a majority of them starts the label model; if no document gets a
toxic label, none is toxic. Ties of the majority count as unlikely to be toxic. Very long texts are scored whole. An empty table
stays empty. Other columns pass through; if one has the name of a result column, ours gets underscores after its name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrograph.llm import grams, linear
from ferrograph.llm.frames import free, text_columns
from ferrograph.llm.quality import sample

MAX_LABELLED = 6000
MAX_TRAIN_ROWS = 3000
#: The labelled sample counts for so much of the corpus in the label model.
SEED_SHARE = 0.5
#: Voters are copies of each other, before anything is fitted, if so much of the information in one is in the other.
SAME_VOTER = 0.9
#: Bytes of the word beginnings that are features and may enter a lexicon.
HEADS = (4, 5, 6)
BITS = 20
#: Price of a weight in the classifier's fit.
L1 = 1e-3
TOXIC_FROM = 0.3
INDUCED = 6
#: A mark is taken from the sample if it is in so many toxic rows, and with so large a share of toxic rows among its own.
LEAST_ROWS = 4
LEAST_PRECISION = 0.9
#: Nats by which a mark must tell more than the best of all that were tried would by chance.
CERTAIN = 2.0

ABUSE = {
    "insult": "idiot idiots moron morons imbecile stupid dumb fool fools loser losers clown clowns",
    "contempt": "pathetic worthless disgusting trash garbage scum filth vermin pig pigs",
    "slur": "bastard bastards bitch bitches whore slut cunt asshole assholes dickhead wanker",
    "vulgar": "fuck fucking fucked fucker shit shitty bullshit crap damn piss",
    "threat": "kill murder strangle stab lynch",
    "de": "idiotin arschloch arschlöcher scheiße scheiss dumm dummkopf trottel hurensohn schlampe abschaum wichser",
    "fr": "connard connards connasse salope salaud merde putain crétin crétins enculé imbécile débile ordure",
    "es": "idiota idiotas imbécil estúpido estúpida mierda puta puto cabrón gilipollas pendejo basura escoria",
}
ADDRESS = "you your youre u he she they du dich dir ihr sie tu toi te vous tú ti usted ustedes eres"
POLITE = "thanks thank please welcome sorry merci pardon danke bitte gracias"
LEET = np.arange(256, dtype=np.uint8)
for a, b in zip(b"013457@$", b"oieastas", strict=True):
    LEET[a] = b


def hashes(terms: list[str]) -> np.ndarray:
    """Hash of each term, which is one word."""
    data, off = grams.text_bytes(pa.array(terms, pa.large_string()))
    return grams.span_hash(grams.prefix_sums(grams.lower(data)), off[:-1], off[1:]) if terms else np.zeros(0, np.uint64)


class Words:
    """The words of a chunk, and hashes of them and of their beginnings."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        low = grams.lower(data)
        self.s, self.e, self.doc = grams.spans(low, off)
        self.sums = grams.prefix_sums(low)
        self.word = grams.span_hash(self.sums, self.s, self.e)

    def heads(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words are longer than n bytes, and the hashes of their first n."""
        k = np.flatnonzero(self.e - self.s > n)
        return k, grams.span_hash(self.sums, self.s[k], self.s[k] + n) ^ np.uint64(n)

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield np.arange(len(self.word)), self.word
        for n in HEADS:
            yield self.heads(n)


class Lookup:
    """Finds the few hashes of a set among many."""

    def __init__(self, keys: np.ndarray, bits: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.bits = keys[order], bits[order]
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "bits": self.bits, "table": None}

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if self.table is None:
            self.table = np.zeros(1 << BITS, bool)
            self.table[self.keys >> np.uint64(64 - BITS)] = True
        at = np.flatnonzero(self.table[h >> np.uint64(64 - BITS)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[k] == h[at]
        return at[hit], self.bits[k[hit]]


@dataclass
class Voters:
    """Lexicons as one table from hash to a mask of voters; names gives each voter its bit."""

    names: list[str]
    lexicon: Lookup
    address: Lookup
    induced: list[str] = field(default_factory=list)

    def votes(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Masks of the voters that say toxic and of those that say clean."""
        docs = len(off) - 1
        yes, no, marks = np.zeros(docs, np.uint64), np.zeros(docs, np.uint64), set()
        bit = {n: np.uint64(1 << k) for k, n in enumerate(self.names)}
        w = Words(data, off)
        abusive = []
        for at, h in w.features():
            k, mask = self.lexicon.find(h)
            polite = (mask & bit["polite"]) != 0
            np.bitwise_or.at(no, w.doc[at[k[polite]]], bit["polite"])
            np.bitwise_or.at(yes, w.doc[at[k[~polite]]], mask[~polite])
            abusive.append(at[k[~polite]])
            marks.update(zip(w.doc[at[k[~polite]]].tolist(), w.word[at[k[~polite]]].tolist(), strict=True))
        hits = np.unique(np.concatenate(abusive))
        if len(hits):
            near, _ = self.address.find(w.word)
            for step in (-2, -1, 1, 2):
                other = near + step
                other = other[(other >= 0) & (other < len(w.word))]
                found = np.intersect1d(other, hits)
                found = found[np.isin(w.doc[found], w.doc[near])]
                np.bitwise_or.at(yes, w.doc[found], bit["addressed"])
        kinds = defaultdict(int)
        for d, _ in marks:
            kinds[d] += 1
        several = np.array([d for d, n in kinds.items() if n >= 2], np.int64)
        yes[several] |= bit["several"]
        plain_at = np.flatnonzero(LEET[data] != data)
        if len(plain_at) and len(self.lexicon.keys):  # disguised spellings
            spelt = LEET[data]
            inside = Words(spelt, off)
            k, mask = self.lexicon.find(inside.word)
            changed = np.searchsorted(plain_at, inside.s[k]) < np.searchsorted(plain_at, inside.e[k])
            np.bitwise_or.at(yes, inside.doc[k[changed & ((mask & bit["polite"]) == 0)]], bit["disguised"])
        capital = grams.range_sums((data >= 65) & (data <= 90), off[:-1], off[1:])
        letters = grams.range_sums(grams.WORD[data], off[:-1], off[1:])
        yes[(letters >= 40) & (capital > 0.6 * letters)] |= bit["shouting"]
        no[(yes == 0) & (letters > 0)] |= bit["unmarked"]
        return yes, no


def distinct(labelled: list) -> list:
    """Without the rows that share one of their three smallest word pair hashes with a row before: copies must not count as evidence again."""
    seen: set[int] = set()
    out = []
    for row in labelled:
        h, doc = grams.words(*grams.text_bytes(pa.array([row[1]], pa.large_string())))
        pair, _ = grams.word_grams(h, doc, 2)
        own = np.unique(pair)[:3].tolist() or [int(np.bitwise_xor.reduce(h))]
        if not seen.intersection(own):
            out.append(row)
        seen.update(own)
    return out


def marks(labelled: list) -> list[int]:
    """Hashes of the words and word beginnings that are in enough toxic rows, and in few others."""
    by: tuple[list, list] = ([], [])
    for _, text, y in labelled:
        w = Words(*grams.text_bytes(pa.array([text], pa.large_string())))
        by[y > 0].append(np.unique(np.concatenate([h for _, h in w.features()])))
    if not by[0] or not by[1]:
        return []
    h, n = np.unique(np.concatenate(by[1]), return_counts=True)
    h, n = h[n >= LEAST_ROWS], n[n >= LEAST_ROWS]
    other = np.concatenate(by[0])
    at = np.searchsorted(h, other)
    ok = at < len(h)
    ok[ok] = h[at[ok]] == other[ok]
    clean = np.bincount(at[ok], minlength=len(h))
    share, base = n / (n + clean), len(by[1]) / (len(by[0]) + len(by[1]))
    with np.errstate(divide="ignore", invalid="ignore"):
        told = (n + clean) * (share * np.log(share / base) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - base)), 0))
    tried = max(1, len(np.unique(np.concatenate([*by[0], *by[1]]))))
    return h[(share >= LEAST_PRECISION) & (told > np.log(tried) + CERTAIN)].tolist()


def voters(labelled: list) -> Voters:
    """The fixed voters, and lexicons of what marks the toxic rows of the sample."""
    names = [*ABUSE, *(f"induced{k}" for k in range(INDUCED)), "addressed", "several", "disguised", "shouting", "polite", "unmarked"]
    bit = {n: 1 << k for k, n in enumerate(names)}
    masks: dict[int, int] = defaultdict(int)
    for name, terms in (*ABUSE.items(), ("polite", POLITE)):
        for h in hashes(terms.split()).tolist():
            masks[h] |= bit[name]
    for h in marks(distinct(labelled)):
        masks[h] |= bit[f"induced{h % INDUCED}"]
    keys = np.array(list(masks), np.uint64)
    address = hashes(ADDRESS.split())
    return Voters(names, Lookup(keys, np.array([masks[int(k)] for k in keys], np.uint64)), Lookup(address, np.ones(len(address), np.uint64)))


@dataclass
class LabelModel:
    """P(class) and, for each voter, P(vote | vote of its parent, class); votes are 0 none, 1 clean, 2 toxic."""

    prior: np.ndarray
    parent: list[int]
    order: list[int]
    table: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(toxic) of each row of votes."""
        log = np.tile(np.log(self.prior), (len(v), 1))
        for j in range(v.shape[1]):
            up = v[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(v), int)
            log += np.where(v[:, j, None] > 0, np.log(self.table[j][:, up, v[:, j]].T), 0)
        return linear.sigmoid(log[:, 1] - log[:, 0])

    def accuracy(self) -> np.ndarray:
        """P(vote is right | it votes), by voter, for voters without parents; others given an abstaining parent."""
        t = self.table[:, :, 0, :]
        right = self.prior[1] * t[:, 1, 2] + self.prior[0] * t[:, 0, 1]
        return right / np.maximum(1e-12, right + self.prior[0] * t[:, 0, 2] + self.prior[1] * t[:, 1, 1])


def unpack(yes: np.ndarray, no: np.ndarray, m: int) -> np.ndarray:
    bits = np.arange(m, dtype=np.uint64)
    yes, no = np.asarray(yes, np.uint64)[:, None], np.asarray(no, np.uint64)[:, None]
    return np.where((yes >> bits) & np.uint64(1), 2, np.where((no >> bits) & np.uint64(1), 1, 0)).astype(np.int64)


def tables(v: np.ndarray, weight: np.ndarray, q: np.ndarray, parent: list[int]) -> tuple[np.ndarray, np.ndarray]:
    by = np.stack([weight * (1 - q), weight * q])
    prior = (by.sum(1) + 1) / (by.sum() + 2)
    out = np.zeros((v.shape[1], 2, 3, 3))
    for j in range(v.shape[1]):
        up = v[:, parent[j]] if parent[j] >= 0 else np.zeros(len(v), int)
        for c in range(2):
            out[j, c] = np.bincount(up * 3 + v[:, j], weights=by[c], minlength=9).reshape(3, 3)
    flat = out.sum(2, keepdims=True)
    flat = (flat + 0.1) / (flat.sum(3, keepdims=True) + 0.3)
    out = out + flat  # votes of a parent that never came with the class say what the voter says on the whole
    out[:, :, :1] = flat  # and so does a parent that doesn't vote
    return prior, out / out.sum(3, keepdims=True)


def fit_label_model(v: np.ndarray, weight: np.ndarray, steps: int = 40, dependent: float = 0.002, seed: tuple[np.ndarray, np.ndarray] | None = None) -> LabelModel:
    """Expectation-maximisation; the tree joins voters whose information about each other, given the class, is over ``dependent`` nats.

    seed: votes and classes of labelled rows, from which it starts; without, it starts from a majority vote in which outright copies of a voter don't count.
    """
    m = v.shape[1]
    parent, order = copies_of(v, weight)
    alone = [j for j in range(m) if parent[j] < 0]
    up, down = (v[:, alone] == 2).sum(1), (v[:, alone] == 1).sum(1)
    q = np.where(up > down, 0.9, np.where(up < down, 0.05, 0.3))
    rows, mass, known = v, weight, np.zeros(0)
    if seed is not None and 0 < seed[1].sum() < len(seed[1]):
        known = seed[1].astype(float)
        rows, mass = np.concatenate([v, seed[0]]), np.concatenate([weight, np.full(len(known), SEED_SHARE * weight.sum() / len(known))])
        q = LabelModel(parent=parent, order=order, **dict(zip(("prior", "table"), tables(seed[0], np.ones(len(known)), known, parent), strict=True))).posterior(v)
    model = None
    for step in range(steps):
        whole = np.concatenate([q, known])
        if step == steps // 3:
            parent, order = tree(rows, mass, whole, dependent)
        prior, table = tables(rows, mass, whole, parent)
        model = LabelModel(prior, parent, order, table)
        q = model.posterior(v)
    return model


def copies_of(v: np.ndarray, weight: np.ndarray) -> tuple[list[int], list[int]]:
    """Each voter's parent among those before it, where it is no more than a copy, and an order in which parents come first."""
    m = v.shape[1]
    parent = [-1] * m
    for j in range(m):
        for i in range(j):
            p = np.bincount(v[:, i] * 3 + v[:, j], weights=weight, minlength=9).reshape(3, 3) / max(1e-12, weight.sum())
            entropy = lambda x: -float((x[x > 0] * np.log(x[x > 0])).sum())
            own, other = entropy(p.sum(0)), entropy(p.sum(1))
            if parent[j] < 0 and min(own, other) > 0 and own + other - entropy(p) >= SAME_VOTER * max(own, other):
                parent[j] = i
    return parent, list(range(m))


def tree(v: np.ndarray, weight: np.ndarray, q: np.ndarray, dependent: float) -> tuple[list[int], list[int]]:
    m, whole = v.shape[1], weight.sum()
    info = np.zeros((m, m))
    for i in range(m):
        for j in range(i):
            for w in (weight * (1 - q), weight * q):
                p = np.bincount(v[:, i] * 3 + v[:, j], weights=w, minlength=9).reshape(3, 3) / max(1e-12, w.sum())
                with np.errstate(divide="ignore", invalid="ignore"):
                    term = p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))
                info[i, j] += np.nansum(term) * w.sum() / whole
            info[j, i] = info[i, j]
    parent, order, left = [-1] * m, [], set(range(m))
    while left:
        links = [(info[i, j], -i, -j) for i in left for j in order if info[i, j] > dependent]
        if links:
            _, i, j = max(links)
            parent[-i] = -j
            i = -i
        else:
            i = min(left)
        order.append(i)
        left.discard(i)
    return parent, order


@dataclass
class Model:
    voters: Voters
    labels: LabelModel | None
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        docs, shift = len(off) - 1, np.uint64(64 - BITS)
        w, at, feature = Words(data, off), [], []
        for k, h in w.features():
            f = (h >> shift).astype(np.int64)
            some = np.flatnonzero(self.weights[f])
            at.append(w.doc[k[some]])
            feature.append(f[some])
        pair = np.unique(np.concatenate(at) * (1 << BITS) + np.concatenate(feature))
        total = self.bias + np.bincount(pair >> BITS, weights=self.weights[pair & ((1 << BITS) - 1)], minlength=docs)
        return np.where(off[1:] > off[:-1], linear.sigmoid(total), 0.0)


def presence(texts: list[str]) -> linear.Rows:
    sizes, idx = [], []
    for text in texts:
        w = Words(*grams.text_bytes(pa.array([text], pa.large_string())))
        f = np.unique(np.concatenate([h for _, h in w.features()]) >> np.uint64(64 - BITS)).astype(np.int32)
        sizes.append(len(f))
        idx.append(f)
    flat = np.concatenate([np.zeros(0, np.int32), *idx])
    return linear.Rows(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), flat, np.ones(len(flat), np.float32))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED, max_train_rows: int = MAX_TRAIN_ROWS) -> Model:
    known = sample(docs, labels, id_col, text, label, max_labelled)
    own = voters(known)
    rows = docs.select(F.col(text).alias("text"))

    def voting(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        yes, no = own.votes(data, off)
        return yes.astype(np.int64), no.astype(np.int64)

    fields = [("yes", T.LongType()), ("no", T.LongType())]
    patterns = text_columns(rows, "text", fields, voting, only=[]).groupBy("yes", "no").count().toPandas()
    none = Model(own, None, np.zeros(1 << BITS, np.float32), -20.0)
    if not len(patterns):
        return none
    v = unpack(patterns["yes"].to_numpy(np.uint64), patterns["no"].to_numpy(np.uint64), len(own.names))
    n = patterns["count"].to_numpy(float)
    told = [own.votes(*grams.text_bytes(pa.array([r[1]], pa.large_string()))) for r in known]
    seed = unpack(np.array([t[0][0] for t in told], np.uint64), np.array([t[1][0] for t in told], np.uint64), len(own.names)), np.array([r[2] > 0 for r in known])
    model = fit_label_model(v, n, seed=seed if known else None)
    q = model.posterior(v)
    toxic = n[q >= 0.5].sum()
    if not toxic:
        return none
    take = np.array([min(1.0, max_train_rows / max(1.0, n.sum() - toxic)), min(1.0, max_train_rows / toxic)])

    def taken(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        yes, no = own.votes(data, off)
        p = model.posterior(unpack(yes, no, len(own.names)))
        h = grams.span_hash(grams.prefix_sums(data), off[:-1], off[1:]) if data.size else np.zeros(len(off) - 1, np.uint64)
        return p, (h >> np.uint64(11)).astype(float) / (1 << 53) < take[(p >= 0.5).astype(int)]

    chosen = text_columns(rows, "text", [("p", T.DoubleType()), ("taken", T.BooleanType())], taken, keep="taken").filter("text is not null").select("text", "p").distinct().collect()
    chosen = [(text, p) for _, text, p in distinct(sorted((r["p"] < 0.5, r["text"], r["p"]) for r in chosen))]
    y = np.array([r[1] for r in chosen])
    weight = np.where(y >= 0.5, 0.5 / max(1, (y >= 0.5).sum()), 0.5 / max(1, (y < 0.5).sum()))
    w, b = linear.fit(presence([r[0] for r in chosen]), y, weight, 1 << BITS, steps=120, rate=0.1, l1=L1, l2=1e-6, least_rows=3)
    if not w.any():
        return none
    return Model(own, model, w.astype(np.float32), b + float(np.log(toxic / max(1.0, n.sum() - toxic))))  # the classes weighed alike in the fit


def scorer(model: Model, toxic_from: float) -> Callable:
    def score(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = model.scores(data, off)
        return np.round(p, 6), p >= toxic_from

    return score


def rate(docs: DataFrame, model: Model, text: str = "text", toxic_from: float = TOXIC_FROM) -> DataFrame:
    """All columns and rows of ``docs``, with ``toxic_probability`` and ``toxic``."""
    fields = [(free(docs.columns, "toxic_probability"), T.DoubleType()), (free(docs.columns, "toxic"), T.BooleanType())]
    return text_columns(docs, text, fields, scorer(model, toxic_from))
