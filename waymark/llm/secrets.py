"""Secret scan: candidates by pattern, and a random forest that removes false positives.

A candidate is a run of at least LEAST letters, digits or `+/_=-` that holds a digit or is as long as a key (LONG). Its features are its length, the share of positions
where the kind of character changes, the mean log-probability of its letter transitions, the share of its letter triples that the corpus'
dictionary covers, the share of digits, whether it names itself a sample, marks of its path (a test, an example), and marks of the words within CONTEXT characters
on its left and right: of keys, of hashes, of keys out of use. Transitions and dictionary come from the words of two letters or more of all documents. The forest is grown level by level from a table of labelled
texts: every tree has its own bootstrap weights and, at every node, its own
subset of features (about TRIED of them); a level is one grouped histogram over (tree, node, feature, bin), whose best splits (TREES * 2^level rows) come to the
driver. Only DataFrame functions run.

Defined results: null and empty texts have no candidates; a null path counts as empty. Candidates that repeat are findings each, at their own place. A text may be of any length. Without
labelled findings of both kinds, every candidate scores the share of positives (1 without any label). Ties between splits go to the
earlier feature, then the smaller bin. Extra columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import stash

LEAST, LONG, CONTEXT = 16, 22, 40
STRIDE = 256
TREES, DEPTH, BINS, TRIED, MOST_OF_A_LABEL = 12, 4, 8, 5, 2000
#: Words beside a secret, beside a hash, and beside a key that isn't in use; and parts of paths that hold samples.
BESIDE = r"(?i)(token|passw|pwd|secret|api|key|auth|bearer|credential)"
SAMPLE_PATH = r"(?i)(test|example|sample|mock|fixture|demo)"
SAYS_SAMPLE = r"(?i)(example|sample|your|change|dummy|placeholder|xxxx|0000)"
HASH_WORDS = r"(?i)\b(commit|merge|revert|revision|git|tree|parent|blob|sha\d+|md5(sum)?|checksum|digest|etag|hash|integrity|base64)\b"
DEAD_WORDS = r"(?i)\b(example|sample|dummy|fake|revoked|expired|rotated|placeholder|not a real|for tests)\b"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{%d,}|[A-Za-z+/_-]{%d,})=*" % (LEAST, LONG)
FEATURES = ["length", "changes", "transitions", "coverage", "digits", "says_sample", "path_sample", "path_depth", "left_keyword", "left_sign", "right_sign", "near_keyword", "near_hash", "near_dead"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, path, n (0-based), start (0-based, in characters), finding, left and right context."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), text.alias("text"))
    rows = rows.where(F.col("text").rlike(CANDIDATE))
    rows = rows.select("doc_id", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split("text", CANDIDATE).alias("around"))
    # what a finding and the text before it take; sums of STRIDE of them, and what stands before each stride
    sizes = F.zip_with(F.slice("around", 1, F.size("found")), "found", lambda x, y: F.length(x) + F.length(y))
    strides = F.transform(F.sequence(F.lit(0), F.floor((F.size("sizes") - 1) / STRIDE)), lambda i: _total(F.slice("sizes", i.cast("int") * STRIDE + 1, STRIDE)))
    before = F.aggregate("strides", F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    rows = rows.withColumn("sizes", sizes).withColumn("strides", strides).withColumn("before", before)

    def one(finding: Column, n: Column) -> Column:
        at = F.get("before", F.floor(n / STRIDE).cast("int")) + _total(F.slice("sizes", F.floor(n / STRIDE).cast("int") * STRIDE + 1, n % STRIDE))
        start = at + F.length(F.get("around", n))
        return F.struct(n.alias("n"), start.alias("start"), finding.alias("finding"), F.right(F.get("around", n), F.lit(CONTEXT)).alias("left"), F.left(F.get("around", n + 1), F.lit(CONTEXT)).alias("right"))

    return rows.select("doc_id", "path", F.inline(F.transform("found", one)))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    words = docs.select(F.explode(F.split(F.lower(text_col), "[^a-z]+")).alias("word"))
    return words.where(F.length("word") >= 2).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _code(char: Column) -> Column:
    return F.ascii(char) - 97


def corpus_tables(docs: DataFrame, text_col: str = "text") -> tuple[list[float], list[int]]:
    """Log-probabilities of the 26 * 26 letter transitions over all words, and a mark for each of the 26^3 letter triples that all words hold more often than the mean triple."""
    counts = stash(word_counts(docs, text_col), "words")
    letter = lambda i: F.ascii(F.substring("word", i, F.lit(1))) - 97
    # pairs and triples in one pass: the third letter is 0 at a word's end
    coded = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: (letter(i) * 26 + letter(i + 1)) * 27 + F.when(i + 2 <= F.length("word"), letter(i + 2) + 1).otherwise(0))
    seen, triples = [1.0] * 676, {}
    for r in counts.select("n", F.explode(coded).alias("code")).groupBy("code").agg(F.sum("n").alias("n")).collect():  # 676 * 27 rows at most
        pair, third = divmod(r["code"], 27)
        seen[pair] += r["n"]
        if third:
            triples[pair * 26 + third - 1] = r["n"]
    logs = [math.log(seen[i] / sum(seen[i // 26 * 26 : i // 26 * 26 + 26])) for i in range(676)]
    usual = sum(triples.values()) / 26**3
    marks = [int(triples.get(t, 0) > usual) for t in range(26**3)]
    return logs, marks


def _literal(numbers: list, kind: str) -> Column:
    return F.split(F.lit(",".join(f"{x:.6g}" for x in numbers)), ",").cast(f"array<{kind}>")


def features(found: DataFrame, logs: list[float], marks: list[int]) -> DataFrame:
    """found with a double column for each of FEATURES."""
    s = F.col("finding")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[^aA0]+", "-")
    codes = F.transform(F.split(F.lower(s), ""), lambda c: F.when(c.between("a", "z"), _code(c)))
    found = found.withColumn("_codes", codes)
    log_table, mark_table = _literal(logs, "double"), _literal(marks, "int")

    def gathered(width: int, table: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size("_codes") - width, F.lit(0)))

        def value(i: Column) -> Column:
            code = F.lit(0)
            for j in range(width):
                code = code * 26 + F.get("_codes", i + j)
            return F.get(table, code)

        return F.transform(places, value)

    def mean(values: Column, default: float) -> Column:
        state = F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.struct((a["s"] + F.coalesce(x.cast("double"), F.lit(0.0))).alias("s"), (a["n"] + F.when(x.isNull(), 0).otherwise(1)).alias("n")))
        return F.when(state["n"] > 0, state["s"] / state["n"]).otherwise(F.lit(default))

    letters = F.length(F.regexp_replace(s, "[^A-Za-z]", ""))
    covered = F.aggregate(gathered(3, mark_table), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    values = {
        "length": F.length(s),
        "changes": (F.length(kinds) - 1) / F.greatest(F.length(s) - 1, F.lit(1)),
        "transitions": mean(gathered(2, log_table), math.log(1 / 26)),
        "coverage": covered / F.greatest(F.length(s) - 2, F.lit(1)),
        "digits": F.length(F.regexp_replace(s, "[^0-9]", "")) / F.greatest(F.length(s), F.lit(1)),
        "says_sample": s.rlike(SAYS_SAMPLE).cast("int"),
        "path_sample": F.col("path").rlike(SAMPLE_PATH).cast("int"),
        "path_depth": F.size(F.split("path", "/")),
        "left_keyword": F.regexp_extract("left", r"(\S+)\s*[=:]?\s*[\"']?$", 1).rlike(BESIDE).cast("int"),
        "left_sign": F.col("left").rlike(r"[=:]\s*[\"']?$").cast("int"),
        "right_sign": F.col("right").rlike(r"^[\"';,]").cast("int"),
        "near_keyword": F.col("left").rlike(BESIDE).cast("int"),
        "near_hash": F.col("left").rlike(HASH_WORDS).cast("int"),
        "near_dead": (F.col("left").rlike(DEAD_WORDS) | F.col("right").rlike(DEAD_WORDS)).cast("int"),
    }
    return found.withColumns({k: v.cast("double") for k, v in values.items()}).drop("_codes")


def bin_edges(rows: DataFrame) -> dict[str, list[float]]:
    """Distinct inner quantiles of each feature over either label of the sample."""
    at = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    got = rows.agg(*[F.percentile(F.when(F.col("label") == x, F.col(f)), at).alias(f"{f}{x}") for f in FEATURES for x in (0, 1)]).first()
    return {f: sorted({*(got[f"{f}0"] or []), *(got[f"{f}1"] or [])}) for f in FEATURES}


def balanced(sample: DataFrame) -> DataFrame:
    """sample with each, a whole weight by which the rarer label counts about as much as the other."""
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}  # two rows
    most = max(n.values(), default=1)
    return sample.withColumn("each", F.when(F.col("label") == 1, max(1, most // n.get(1, most))).otherwise(max(1, most // n.get(0, most))))


def grow(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> list[dict]:
    """A forest for labelled (FEATURES, label 0/1, key): for each tree {node: ("split", feature, edge) or ("leaf", share of positives)}.

    At most MOST_OF_A_LABEL findings of either label, chosen by the hash of their key, so that the rarer one is never crowded out. Leaves are
    shares of weights in that sample, not in the corpus. Node n has children 2n (values up to the edge) and 2n + 1.
    """
    drawn = [labelled.where(F.col("label") == x).select("key", "label", *FEATURES).orderBy(F.xxhash64("key"), "key").limit(MOST_OF_A_LABEL) for x in (0, 1)]
    sample = balanced(stash(drawn[0].unionByName(drawn[1]), "labelled"))
    edges = bin_edges(sample)
    draw = F.pmod(F.xxhash64("key", "tree"), F.lit(1000)) / 1000.0  # Poisson(1) weights
    times = F.when(draw < 0.368, 0).when(draw < 0.736, 1).when(draw < 0.920, 2).when(draw < 0.981, 3).otherwise(4)
    weight = F.when(F.col("each") > 1, F.col("each") * F.greatest(times, F.lit(1))).otherwise(times)  # no tree goes without a rare label
    rows = sample.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("w", weight).where("w > 0")
    rows = stash(rows.withColumn("p", F.col("w") * F.col("label")), "weighted")
    binned = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), _bin(F.col(f), edges[f]).alias("b")) for i, f in enumerate(FEATURES)])).alias("x")
    tried = F.pmod(F.xxhash64("tree", "node", "x.f"), F.lit(len(FEATURES))) < TRIED

    forest: list[dict] = [{} for _ in range(trees)]
    for level in range(depth + 1):
        placed = rows.withColumn("node", _node(forest)).where(F.col("node") >= 2**level)
        totals = placed.groupBy("tree", "node").agg(F.sum("w").alias("n"), F.sum("p").alias("p")).collect()  # trees * 2^level rows
        open_nodes = {}
        for r in totals:
            n, p = float(r["n"]), float(r["p"])
            forest[r["tree"]][r["node"]] = ("leaf", p / n)
            if level < depth and 0 < p < n:
                open_nodes[r["tree"], r["node"]] = (n, p)
        if not open_nodes:
            break
        histogram = placed.select("tree", "node", "w", "p", binned).where(tried).groupBy("tree", "node", "x.f", "x.b").agg(F.sum("w").alias("n"), F.sum("p").alias("p"))
        bins = {(r["tree"], r["node"], r["f"], r["b"]): (float(r["n"]), float(r["p"])) for r in histogram.collect()}  # trees * 2^level * FEATURES * 2 * BINS rows
        for (t, node), (n, p) in open_nodes.items():
            found = _best_split(n, p, {f: [bins.get((t, node, f, b), (0.0, 0.0)) for b in range(len(edges[name]))] for f, name in enumerate(FEATURES)})
            if found:
                forest[t][node] = ("split", FEATURES[found[0]], edges[FEATURES[found[0]]][found[1]])
    return forest


def _best_split(n: float, p: float, bins: dict[int, list[tuple[float, float]]]) -> tuple[int, int] | None:
    """Feature and bin of the split with the least Gini impurity, if it is less than the node's."""
    best = (2 * p * (1 - p / n) - 1e-9, -1, -1)
    for f, counts in bins.items():
        left_n = left_p = 0.0
        for b, (bn, bp) in enumerate(counts):
            left_n, left_p = left_n + bn, left_p + bp
            if 0 < left_n < n:
                best = min(best, (2 * left_p * (1 - left_p / left_n) + 2 * (p - left_p) * (1 - (p - left_p) / (n - left_n)), f, b))
    return best[1:] if best[1] >= 0 else None


def _node(forest: list[dict]) -> Column:
    """The node a row of a tree has come to."""

    def at(tree: dict, node: int) -> Column:
        what = tree.get(node)
        if what is None or what[0] == "leaf":
            return F.lit(node)
        return F.when(F.col(what[1]) <= what[2], at(tree, 2 * node)).otherwise(at(tree, 2 * node + 1))

    return F.coalesce(*[F.when(F.col("tree") == t, at(tree, 1)) for t, tree in enumerate(forest)])


def _bin(value: Column, edges: list[float]) -> Column:
    """How many edges lie below value."""
    return sum((F.when(value > e, 1).otherwise(0) for e in edges), F.lit(0))


def forest_score(forest: list[dict]) -> Column:
    """Mean of the trees' leaves."""

    def at(tree: dict, node: int) -> Column:
        what = tree.get(node, ("leaf", 1.0))  # 1: nothing was labelled
        if what[0] == "leaf":
            return F.lit(float(what[1]))
        return F.when(F.col(what[1]) <= what[2], at(tree, 2 * node)).otherwise(at(tree, 2 * node + 1))

    return sum((at(tree, 1) for tree in forest), F.lit(0.0)) / len(forest)


def labelled_features(labelled: DataFrame, logs: list[float], marks: list[int], text_col: str = "text", path_col: str = "source") -> DataFrame:
    """The candidates of labelled texts (doc_id, text, path, label 1 or 0 for all that a text holds) with their features, label and key."""
    found = features(candidates(labelled, "doc_id", text_col, path_col), logs, marks)
    label = labelled.where(F.col("label").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("label").cast("int").alias("label"))
    return found.join(label, F.col("doc_id") == F.col("_id")).withColumn("key", F.concat_ws("#", F.col("doc_id").cast("string"), "n"))


def scan(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, n, start, finding, score and secret (score over one half) for every candidate of docs; labelled: doc_id, text, source, label."""
    logs, marks = corpus_tables(docs, text_col)
    forest = grow(labelled_features(labelled, logs, marks))
    found = features(candidates(docs, id_col, text_col, path_col), logs, marks)
    return found.select("doc_id", "n", "start", "finding", forest_score(forest).alias("score")).withColumn("secret", F.col("score") > 0.5)
