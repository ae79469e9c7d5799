"""Subject areas of documents: labelling functions under an accuracy-learning latent model.

1. Lexicon: from a bounded sample of hand-labelled documents (`label_rows`), word sequences of one to four words that
   occur with one subject; sentences of a document with several labels are shared out among them by expectation and
   maximisation, so a phrase ends up with the one it belongs to.
2. Labelling functions vote on every (document, subject): the lexicon (at least a quarter of the sentences that concern
   any subject concern this one), the subjects' descriptions, the section headings, the address (what else is known about
   the repository), the kind of source (both counted over all labels), and, where there is one, the hand-made label. Whole texts are read.
3. The votes of all documents are counted per subject and pattern (a bounded table: three values, six functions). On it,
   expectation-maximisation learns how often each function is right, without knowing the truth.
4. A document has the subjects whose posterior probability is at least one half. The hand-made label helps to learn the
   accuracies, but isn't used in the posterior: some labels are wrong.

Defined results: null and blank texts concern nothing and get no subject; labels are compared in lower case, those that
name no subject (nor a word of just one description, nor start like one) are ignored; repeated labels count once; labels
of documents that don't exist are ignored; without labels the lexicon is that of the descriptions; repeated rows are
judged each; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.session import cut

LABEL_ROWS = 6000
SAMPLE_CHARS = 20_000  # longer texts are not used for learning the lexicon
LONGEST = 4
LEAST_DOCS = 3
PURITY = 0.5
PURITY_WORD = 0.8
COMMON_DOCS = 15
COMMON_SHARE = 0.35
SHARE = 0.25
FUNCTIONS = ("lexicon", "description", "section", "address", "source", "label")
ALIASES = {"legal": "law", "food": "cooking", "sports": "sport", "health": "medicine", "medical": "medicine", "programming": "software", "farming": "agriculture", "travel": "transport", "transportation": "transport", "space": "astronomy", "banking": "finance", "money": "finance", "teaching": "education", "life science": "biology"}  # fixed values: other spellings of labels

FENCE = re.compile(r"^\s*(?:```|~~~)")
END = re.compile(r"[.!?][\"')\]]*\s+")
CODE = re.compile(r"`[^`\n]*`|https?://\S+")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", re.UNICODE)
ASCII_WORD = re.compile(r"[a-z]+(?:['-][a-z]+)*")
HEADING = re.compile(r"^\s*#+\s+(.*)$")


def _words(s: str) -> list[str]:
    return ASCII_WORD.findall(s.lower()) if s.isascii() else [w.lower() for w in WORD.findall(s)]


def _split(line: str) -> list[str]:
    """Sentences of a line, without quotes and brackets after the last sign."""
    out, at = [], 0
    for m in END.finditer(line):
        out.append(line[at : m.start() + 1])
        at = m.end()
    return [*out, line[at:]]


def sentences(text: str | None) -> tuple[list[list[str]], list[list[str]]]:
    """(sentences, headings) as lists of lower-case words; code is left out."""
    out: list[list[str]] = []
    heads: list[list[str]] = []
    if not text:
        return out, heads
    fenced = False
    for line in text.splitlines():
        if ("```" in line or "~~~" in line) and FENCE.match(line):
            fenced = not fenced
            continue
        if fenced or not line.strip():
            continue
        h = HEADING.match(line) if "#" in line else None
        if h:
            heads.append(_words(h[1]))
            continue
        for s in _split(CODE.sub(" \x00 ", line) if "`" in line or "://" in line else line):
            s = s.strip()
            if s and s.rstrip("\"')]").endswith((".", "!", "?", ";", ":")):
                out.append(_words(s))
    return out, heads


def grams(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in range(1, LONGEST + 1) for i in range(len(words) - n + 1)]


def _incidences(docs: list[tuple[list[list[str]], frozenset[str]]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(sequences that occur in `LEAST_DOCS` documents or more, their support, and for each occurrence, once a sentence and in the order of
    `grams`: sentence, sequence)."""
    number: dict[str, int] = {}
    g, s, d, n = [], [], [], 0
    for i, (sents, _) in enumerate(docs):
        for words in sents:
            own = [number.setdefault(x, len(number)) for x in dict.fromkeys(grams(words))]
            g += own
            s += [n] * len(own)
            d += [i] * len(own)
            n += 1
    g, s, d = np.array(g, np.int64), np.array(s, np.int64), np.array(d, np.int64)
    support = np.bincount(np.unique(g * (len(docs) + 1) + d) // (len(docs) + 1), minlength=len(number)) if len(g) else np.zeros(0, np.int64)
    kept = support >= LEAST_DOCS
    new = np.cumsum(kept) - 1
    ok = kept[g] if len(g) else np.zeros(0, bool)
    return [x for x, k in zip(number, kept) if k], support[kept], s[ok], new[g[ok]] if len(g) else g


def learn(docs: list[tuple[list[list[str]], frozenset[str]]], subjects: list[str], rounds: int = 5) -> dict[str, tuple[str, float]]:
    """{word sequence: (subject, share)} from (sentences, labels) of documents. A sentence belongs to each label of its document
    by as much as its three most telling sequences say."""
    names, support, sent, gram = _incidences(docs)
    if not names:
        return {}
    labels = ["", *sorted({x for _, ls in docs for x in ls} - {""})]
    at = {x: i for i, x in enumerate(labels)}
    member = np.zeros((sum(len(x) for x, _ in docs), len(labels)))  # the labels of a sentence's document; none is the first
    n = 0
    for sents, ls in docs:
        member[n : n + len(sents), [at[x] for x in ls] or [0]] = 1
        n += len(sents)

    def counted(g: np.ndarray, shares: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(g, shares[:, k], len(names)) for k in range(len(labels))], 1)

    # documents of one label, or none, say the same in every round
    several = member.sum(1) > 1
    open_ = several[sent]
    fixed = counted(gram[~open_], member[sent[~open_]])
    sent, gram = sent[open_], gram[open_]
    rows, sent = np.unique(sent, return_inverse=True)
    own = member[rows]
    shares = own / np.maximum(own.sum(1, keepdims=True), 1)
    weight = fixed / np.maximum(fixed.sum(1, keepdims=True), 1e-300)
    for i in range(rounds):
        if i and len(sent):
            telling = weight.max(1)
            strong = np.flatnonzero(telling[gram] > 0.3)
            strong = strong[np.lexsort((strong, -telling[gram[strong]], sent[strong]))]
            rank = np.arange(len(strong)) - np.searchsorted(sent[strong], sent[strong])
            strong = strong[rank < 3]
            score = np.zeros_like(own)
            np.add.at(score, sent[strong], np.log(weight[gram[strong]] + 0.03))
            score = np.where(own > 0, score, -np.inf)
            e = np.exp(score - score.max(1, keepdims=True))
            shares = e / e.sum(1, keepdims=True)  # where nothing is telling all scores are 0, hence the shares even
        both = fixed + counted(gram, shares[sent])
        weight = both / both.sum(1, keepdims=True)
    # words that go with every subject are those of sentence patterns; a phrase neither begins nor ends with one
    top = weight.max(1)
    common = {g for g, n, w in zip(names, support, top) if " " not in g and n >= COMMON_DOCS and w < COMMON_SHARE}
    out = {}
    for g, w, share in zip(names, weight, top):
        if share >= (PURITY if " " in g else PURITY_WORD) and g.split(" ", 1)[0] not in common and g.rsplit(" ", 1)[-1] not in common:
            best = max(labels[k] for k in np.flatnonzero(w == share))
            if best in subjects:
                out[g] = (best, float(share))
    return out


class Lexicon:
    """Word sequences by their first word, so that a sentence is tried only where one can begin."""

    def __init__(self, phrases: dict[str, tuple[str, float]]) -> None:
        self.phrases, self.sizes = phrases, {}
        for p in phrases:
            words = p.split(" ")
            self.sizes.setdefault(words[0], set()).add(len(words))

    def __bool__(self) -> bool:
        return bool(self.phrases)


def concerned(sentence: list[str], lexicon: Lexicon) -> set[str]:
    """Subjects of a sentence: longest sequences first, no word twice; a subject with less than half the weight of the
    strongest one is a chance word of that one's phrase."""
    sizes, phrases, hits = lexicon.sizes, lexicon.phrases, []
    for i, w in enumerate(sentence):
        if w in sizes:
            for size in sizes[w]:
                hit = phrases.get(w if size == 1 else " ".join(sentence[i : i + size]))
                if hit and i + size <= len(sentence):
                    hits.append((-size, i, hit))
    subjects = {h[2][0] for h in hits}
    if len(subjects) < 2:
        return subjects
    hits.sort(key=lambda h: h[:2])
    score: dict[str, float] = {}
    used: set[int] = set()
    for size, i, (subject, weight) in hits:
        words = range(i, i - size)
        if used.isdisjoint(words):
            score[subject] = score.get(subject, 0.0) - weight * size
            used.update(words)
    top = max(score.values())
    return {s for s, v in score.items() if v >= top / 2}


def normal_label(label: str | None, subjects: dict[str, str]) -> str | None:
    """The subject that a label means, '' for none, None for an unknown one."""
    x = (label or "").strip().lower()
    if x in ("none", "no subject", ""):
        return "" if x else None
    if x in subjects:
        return x
    if x in ALIASES and ALIASES[x] in subjects:
        return ALIASES[x]
    near = [s for s in subjects if s.startswith(x) or x.startswith(s)]
    near = near or [s for s, d in subjects.items() if re.search(rf"\b{re.escape(x)}\b", d.lower())]
    return near[0] if len(near) == 1 else None


def tendencies(facts: DataFrame, value: str, subjects: list[str], n: int, base: dict[str, int], least: int = 8) -> DataFrame:
    """(value, votes by subject) where the labelled documents of a value have a subject clearly more, or less, often than
    others; `n` and `base` count all labelled documents and those of each subject."""
    by = facts.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), *(F.count_if(F.array_contains("meant", s)).alias(f"c{i}") for i, s in enumerate(subjects))).where(F.col("n") >= least)
    rate = lambda i: F.col(f"c{i}") / F.col("n")
    votes = [F.when(rate(i) > max(0.4, 3 * base[s] / n), 1).when((rate(i) < base[s] / n / 4) & (F.col("n") >= 30), -1).otherwise(0) for i, s in enumerate(subjects)]
    return by.select(value, F.array(*votes).alias(f"{value}_votes"))


def em(patterns: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 40) -> tuple[np.ndarray, float]:
    """(P(vote | truth) as [function, truth, vote + 1], prior of the subject) from patterns of votes."""
    k = patterns.shape[1]
    p = np.full((k, 2, 3), 1 / 3)
    for j, right in enumerate((0.95, 0.7, 0.7, 0.6, 0.6, 0.9)[:k]):
        p[j, 1] = [(1 - right) / 2, 1 - right, right]
        p[j, 0] = [right, 1 - right, (1 - right) / 2]
        p[j] /= p[j].sum(1, keepdims=True)
    v = patterns + 1
    for _ in range(rounds):
        ll = np.stack([np.log([1 - prior, prior][y]) + sum(np.log(p[j, y, v[:, j]]) for j in range(k)) for y in (0, 1)], 1)
        post = np.exp(ll - ll.max(1, keepdims=True))
        post = post[:, 1] / post.sum(1)
        prior = float(np.clip((counts * post).sum() / counts.sum(), 1e-4, 0.9))
        for j in range(k):
            for y, w in ((1, counts * post), (0, counts * (1 - post))):
                c = np.array([w[v[:, j] == x].sum() for x in range(3)]) + 0.5
                p[j, y] = c / c.sum()
    return p, prior


def posterior(votes: np.ndarray, p: np.ndarray, prior: float) -> np.ndarray:
    """Without the last function, the hand-made label."""
    k = p.shape[0] - 1
    ll = [math.log(x) + sum(np.log(p[j, y, votes[:, j] + 1]) for j in range(k)) for y, x in ((0, 1 - prior), (1, prior))]
    return 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -60, 60)))


def assign(docs: DataFrame, subjects: DataFrame, labels: DataFrame, label_rows: int = LABEL_ROWS) -> DataFrame:
    """(doc_id, subject, probability, share, repo, source, lang): every (document, subject) with probability of one half
    or more."""
    spark = docs.sparkSession
    known = {r["subject"]: r["description"] or "" for r in subjects.collect() if r["subject"]}  # a small fixed table
    names = sorted(known)
    cols = ["doc_id", "text", "repo", "source", "lang"]
    d = docs.select(*cols)
    spec = "doc_id bigint, subject string, probability double, share double, repo string, source string, lang string"
    if not names:
        return spark.createDataFrame([], spec)

    by_doc = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
    # the lexicon: a bounded sample of labelled documents, whole texts; ordered by a hash, so that it is the same every time
    order = [F.xxhash64("doc_id"), F.xxhash64("text")]
    sample = d.join(by_doc, "doc_id").where(F.length("text") <= SAMPLE_CHARS).orderBy(*order).limit(label_rows).select("text", "labels").toArrow().to_pylist()
    examples = []
    for r in sample:
        ls = {normal_label(x, known) for x in r["labels"]} - {None}
        if ls:
            examples.append((sentences(r["text"])[0], frozenset(ls - {""})))
    lexicon = learn(examples, names)
    words = {w: s for s in names for w in {x.lower() for x in WORD.findall(known[s])} if sum(bool(re.search(rf"\b{w}\b", t.lower())) for t in known.values()) == 1 and len(w) > 4}
    if not lexicon:
        lexicon = {w: (s, 1.0) for w, s in words.items()}
    # addresses, sources and priors: all labels
    def mean(batches):
        for b in batches:
            meant = [{normal_label(x, known) for x in ls} - {None} for ls in b.column("labels").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([sorted(x - {""}) if x else None for x in meant], pa.list_(pa.string()))], ["doc_id", "meant"])

    meant = by_doc.mapInArrow(mean, f"doc_id {by_doc.schema['doc_id'].dataType.simpleString()}, meant array<string>").where("meant is not null")
    facts, _ = cut(d.where("text is not null").select("doc_id", "repo", "source").join(meant, "doc_id"), "facts")
    total, *each_ = facts.agg(F.count("*"), *(F.count_if(F.array_contains("meant", s)) for s in names)).first()
    base = dict(zip(names, each_))
    shared = spark.sparkContext.broadcast((Lexicon(lexicon), words))

    at = {s: i for i, s in enumerate(names)}
    none = sum(3**j for j in range(1, len(FUNCTIONS)))  # the lexicon says no, the others nothing; address, source and label are added where they are joined

    def vote(batches):
        """Votes as one number: digit j, of base three, is the vote of function j plus one."""
        lexicon, words = shared.value
        for b in batches:
            votes, shares = [], []
            for text in b.column("text").to_pylist():
                sents, heads = sentences(text)
                per = [concerned(s, lexicon) for s in sents]
                any_ = sum(bool(x) for x in per)
                count = Counter(s for x in per for s in x)
                said = Counter(words[w] for s in sents for w in s if w in words)
                titled = {s for h in heads for s in concerned(h, lexicon)}
                row, sh = [none] * len(names), [0.0] * len(names)
                for s, n in count.items():
                    sh[at[s]] = n / any_
                    row[at[s]] += 2 * (n / any_ >= SHARE)
                most = max(said.values(), default=0)
                for s, n in said.items():
                    row[at[s]] += 3 * (n == most)
                for s in titled:
                    row[at[s]] += 9
                votes.append(row)
                shares.append(sh)
            keep = [b.column(c) for c in ("doc_id", "repo", "source", "lang")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(votes, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float64()))], ["doc_id", "repo", "source", "lang", "votes", "shares"])

    doc_type = d.schema["doc_id"].dataType.simpleString()
    voted, _ = cut(d.where("text is not null").mapInArrow(vote, f"doc_id {doc_type}, repo string, source string, lang string, votes array<int>, shares array<double>"), "votes")
    if total:
        for j, value in ((FUNCTIONS.index("address"), "repo"), (FUNCTIONS.index("source"), "source")):
            known_votes = tendencies(facts, value, names, total, base)
            voted = voted.join(known_votes, value, "left").withColumn("votes", F.coalesce(F.expr(f"zip_with(votes, {value}_votes, (x, y) -> x + y * {3**j})"), "votes")).drop(f"{value}_votes")
        own = F.expr(f"zip_with(votes, names, (x, s) -> x + {3 ** FUNCTIONS.index('label')} * case when meant is null then 0 when array_contains(meant, s) then 1 else -1 end)")
        voted = voted.withColumn("names", F.array(*map(F.lit, names))).join(meant, "doc_id", "left").withColumn("votes", own).drop("names", "meant")
        voted, _ = cut(voted, "votes")
    each = voted.select("doc_id", "repo", "source", "lang", F.posexplode(F.arrays_zip("votes", "shares")).alias("i", "v")).select("doc_id", "repo", "source", "lang", "i", F.col("v.votes").alias("pattern"), F.col("v.shares").alias("share"))
    table = each.groupBy("i", "pattern").agg(F.count("*").alias("n")).collect()  # at most subjects x 3^6 rows
    prior = {s: max(0.02, base[s] / max(1, total)) for s in names}
    scored = []
    for i, s in enumerate(names):
        own = [(r["pattern"], r["n"]) for r in table if r["i"] == i]
        if own:
            codes = np.array([c for c, _ in own])
            votes = np.stack([codes // 3**j % 3 - 1 for j in range(len(FUNCTIONS))], 1)
            p, pr = em(votes, np.array([n for _, n in own], float), prior[s])
            scored += [(i, int(c), s, float(q)) for c, q in zip(codes, posterior(votes, p, pr)) if q >= 0.5]
    good = spark.createDataFrame(scored, "i int, pattern int, subject string, probability double")
    return each.join(F.broadcast(good), ["i", "pattern"]).select("doc_id", "subject", "probability", "share", "repo", "source", "lang")


def composition(assigned: DataFrame) -> DataFrame:
    """Documents per subject and source."""
    return assigned.groupBy("subject", "source").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.avg("share"), 6).alias("mean_share"))
