"""Keyword taxonomy over free text, as column expressions.

Each rule counts how many of its keywords occur in the lower-cased text; the rule with most
hits wins and the earlier rule wins a tie. No UDF and no shuffle: the classifier is a chain of
projections over the scan. Rules in thousands are a table of their own, joined through an index of
the runs of characters in their keywords.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger.functions.text import is_blank, sql_text
from lossledger.session import stage


@dataclass(frozen=True)
class Rule:
    category: str
    subcategory: str
    keywords: tuple[str, ...]


# Rules in order of precedence, with their keywords.
RULES: tuple[Rule, ...] = (
    Rule("Commercial", "pricing_concerns",
         ("pricing", "price", "budget", "cost", "invoice", "billing", "discount", "renewal")),
    Rule("Product", "missing_templates",
         ("template", "templates", "library", "variety")),
    Rule("Product", "missing_features",
         ("feature", "capability", "advanced", "permissions", "controls")),
    Rule("Product", "performance_reliability",
         ("slow", "lag", "crash", "performance", "failed", "imports", "unstable", "loading")),
    Rule("Product", "export_limitations",
         ("export", "watermark", "preview")),
    Rule("Operational", "onboarding_confusion",
         ("onboarding", "time to value", "adoption", "confusion", "setup")),
    Rule("Operational", "support_quality",
         ("support", "resolution", "ticket", "unresolved", "response")),
    Rule("Competitive", "competitor_switch",
         ("competitor", "switched", "canva", "adobe express", "figma", "piktochart")),
    Rule("Competitive", "competitor_advantage",
         ("already uses", "familiarity", "existing workflows", "stronger")),
    Rule("Adoption / Value Realization", "low_usage",
         ("low usage", "weak adoption", "did not create", "limited engagement", "justify the subscription")),
    Rule("Adoption / Value Realization", "low_team_adoption",
         ("team adoption", "stakeholders", "team already uses")),
)

# Outcome and confidence when no rule applies.
NO_CATEGORY = "Uncategorized"
NO_SUBCATEGORY = "unclear_signal"
BLANK_CONFIDENCE = 0.1
NO_HIT_CONFIDENCE = 0.25

# A table of keywords up to this size is sent to every task; a larger one is shuffled.
INDEX_BYTES = 32 << 20
GRAM = 3
TEXT_BYTES = 1 << 20  # text a task searches at once
PAIRS = 1 << 20  # candidates a task compares at once


def classify(df: DataFrame, text_col: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Append ``category, subcategory, matched_terms, confidence`` for the text in ``text_col``.

    One expression per keyword, made for rule sets like the fixed one; ``classify_indexed`` gives the
    same for rules that are a table, in thousands.

    The winning rule is passed through an ``explode`` of one element. A filter on the outcome
    would otherwise be rewritten by the optimizer into one on the text, repeating the counting
    of all rules for every branch of the rule ladder; it does not move past a generator.
    """
    # Without rules nothing can win; a rule that no text can hit keeps the plan the same.
    rules = rules or (Rule(NO_CATEGORY, NO_SUBCATEGORY, ("\x00\x00",)),)
    # Past a generator of its own the text is made once, and its making stays out of the method that counts,
    # which must be short enough to be compiled to machine code.
    lowered = df.withColumn("_text", F.explode(F.array(F.coalesce(F.lower(F.col(text_col)), F.lit("")))))
    return _with_outcome(_winner_inline(lowered, rules), df.columns)


def _with_outcome(winner: DataFrame, kept: Sequence[str]) -> DataFrame:
    """The columns ``kept`` and what the winning rule in ``_won`` says."""
    found = F.coalesce(F.col("_won.hits") > 0, F.lit(False))
    return winner.select(
        *(F.col(f"`{c}`") for c in kept),
        F.when(found, F.col("_won.category")).otherwise(NO_CATEGORY).alias("category"),
        F.when(found, F.col("_won.subcategory")).otherwise(NO_SUBCATEGORY).alias("subcategory"),
        F.when(found, F.col("_won.terms")).otherwise("").alias("matched_terms"),
        F.when(found, F.least(F.lit(0.95), (F.col("_won.hits") + 5) / 10.0))
        .when(F.col("_won.blank"), BLANK_CONFIDENCE)
        .otherwise(NO_HIT_CONFIDENCE)
        .alias("confidence"),
    )


def _winner_inline(lowered: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One hit counter per rule, then CASE ladders in rule order.

    Written as SQL text: a few hundred expressions parse faster than they are built one by one.
    """

    def counter(rule: Rule) -> str:
        return " + ".join(f"int(contains(_text, {sql_text(k)}))" for k in rule.keywords)

    def ladder(outcome: Callable[[Rule], str]) -> str:
        *earlier, last = rules
        branches = " ".join(f"WHEN _n{i} = _hits THEN {outcome(r)}" for i, r in enumerate(earlier))
        return f"CASE {branches} ELSE {outcome(last)} END" if earlier else outcome(last)

    def terms(rule: Rule) -> str:
        # The terms are sorted here, so the joined string is sorted; absent ones are skipped.
        found = (f"CASE WHEN contains(_text, {sql_text(k)}) THEN {sql_text(k)} END" for k in sorted(set(rule.keywords)))
        return f"concat_ws(', ', {', '.join(found)})"

    counts = ", ".join(f"_n{i}" for i in range(len(rules)))
    counted = lowered.selectExpr("*", *(f"{counter(r)} AS _n{i}" for i, r in enumerate(rules)))
    ranked = counted.selectExpr("*", f"greatest({counts}) AS _hits" if len(rules) > 1 else f"{counts} AS _hits")
    won = F.struct(
        F.col("_hits").alias("hits"),
        ((F.col("_hits") == 0) & is_blank(F.col("_text"))).alias("blank"),
        F.expr(ladder(lambda r: sql_text(r.category))).alias("category"),
        F.expr(ladder(lambda r: sql_text(r.subcategory))).alias("subcategory"),
        F.expr(f"CASE WHEN _hits > 0 THEN {ladder(terms)} END").alias("terms"),
    )
    return ranked.withColumn("_won", F.explode(F.array(won)))


def rules_table(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Rules as a table, one row per keyword; ``rule`` is the order of precedence."""
    return spark.createDataFrame(
        [(i, r.category, r.subcategory, k) for i, r in enumerate(rules) for k in r.keywords],
        "rule bigint, category string, subcategory string, keyword string")


def _grams(text: Column, sizes: Sequence[int]) -> Column:
    """The distinct runs of so many characters in a text."""
    characters = F.split(text, "")

    def runs(size: int) -> Column:
        last = F.size(characters) - size
        run = lambda i: F.concat(*(F.get(characters, i + j) for j in range(size)))
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), run)).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(runs, sizes)))


def keyword_index(rules: DataFrame) -> DataFrame:
    """``gram, rule, keyword``: each keyword under the run of three characters that fewest keywords share.

    A text that contains a keyword contains its run. Keywords of fewer characters stand under themselves.
    Keywords that are null or empty take no part, repeated ones count once.
    """
    keywords = stage(rules.where("keyword <> ''").select("rule", F.lower("keyword").alias("keyword")).distinct())
    runs = F.when(F.length("keyword") < GRAM, F.array("keyword")).otherwise(_grams(F.col("keyword"), [GRAM]))
    # The split into characters may end with an empty one, so the last run may be too short.
    each = keywords.withColumn("gram", F.explode(runs)).where(F.length("gram") >= F.least(F.length("keyword"), F.lit(GRAM)))
    shared = each.groupBy("gram").agg(F.count(F.lit(1)).alias("_shared"))
    rarest = F.min(F.struct("_shared", "gram")).alias("rarest")
    return each.join(shared, "gram").groupBy("rule", "keyword").agg(rarest).select("rarest.gram", "rule", "keyword")


class _Finder:
    """Keywords of an index, sought in many texts at once.

    A position is a candidate if the first three bytes there open the run that a keyword stands under
    (all of it, if it is shorter). Candidates are compared with the keyword byte by byte.
    """

    def __init__(self, grams: list[str], keywords: list[str]):
        self.words = sorted({k.encode() for k in keywords})
        at = {w: i for i, w in enumerate(self.words)}
        opening: dict[int, dict[int, set[tuple[int, int]]]] = {}
        for gram, keyword in zip(grams, keywords):
            run, word = gram.encode(), keyword.encode()
            code = int.from_bytes(run[:GRAM], "big")
            opening.setdefault(len(run[:GRAM]), {}).setdefault(code, set()).add((at[word], word.index(run)))
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)]
        self.letters = np.frombuffer(b"".join(self.words), np.uint8)
        self.opening = []
        for width, codes in opening.items():
            known = np.zeros(256**width, bool)
            known[list(codes)] = True
            entries = [sorted(codes[c]) for c in sorted(codes)]
            self.opening.append((width, known, np.array(sorted(codes)), np.array([len(e) for e in entries]),
                                 np.array([e for some in entries for e in some], np.int64)))

    def find(self, ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of text and keyword, by number, each once and in order."""
        found = [np.empty(0, np.int64)]
        for width, known, codes, many, entries in self.opening:
            rolled = np.zeros(max(0, len(data) - width + 1), np.int32)
            for i in range(width):
                rolled = rolled << 8 | data[i : len(data) - width + 1 + i]
            hit = np.flatnonzero(known[rolled])
            of = np.searchsorted(codes, rolled[hit])
            first = np.r_[0, np.cumsum(many)]
            upto = np.cumsum(many[of])
            for low, high in _parts(upto, PAIRS):
                times = many[of[low:high]]
                place = np.repeat(np.arange(low, high), times)
                nth = np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
                word, offset = entries[first[of[place]] + nth].T
                begin = hit[place] - offset
                text = np.searchsorted(ends, hit[place], "right") - 1
                inside = (begin >= ends[text]) & (begin + self.lengths[word] <= ends[text + 1])
                found.append(np.unique(self._same(data, text[inside], word[inside], begin[inside])))
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.words)), pairs % max(1, len(self.words))

    def _same(self, data, text, word, begin) -> np.ndarray:
        done, i = [np.empty(0, np.int64)], 0
        while len(word):
            over = self.lengths[word] == i
            done.append(text[over] * len(self.words) + word[over])
            go = ~over
            text, word, begin = text[go], word[go], begin[go]
            same = data[begin + i] == self.letters[self.starts[word] + i]
            text, word, begin, i = text[same], word[same], begin[same], i + 1
        return np.concatenate(done)


def _parts(upto: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes, given as running totals, add up to ``most`` or are one item's."""
    low = 0
    while low < len(upto):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + most, "right")))
        yield low, high
        low = high


def _winner_by_index(texts: DataFrame, index: DataFrame, named: DataFrame) -> DataFrame:
    """``_won`` for the text in ``_text`` by an index that every task gets."""
    of = {r["rule"]: (r["category"], r["subcategory"]) for r in named.collect()}
    # As in the shuffled way: a rule without a number takes part and, with its hits, hides what it beats.
    order = sorted(set(of) | {r[0] for r in index.select("rule").distinct().collect()}, key=lambda r: (r is None, r))
    listed = [(r["gram"], r["rule"], r["keyword"]) for r in index.collect()]
    shared = index.sparkSession.sparkContext.broadcast((listed, order, of))

    def search(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        listed, order, of = shared.value
        finder = _Finder([e[0] for e in listed], [e[2] for e in listed])
        rank, words = {r: i for i, r in enumerate(order)}, {w: i for i, w in enumerate(finder.words)}
        owns = sorted((words[keyword.encode()], rank[rule]) for _, rule, keyword in listed)
        word_of, rules = np.array(owns, np.int64).reshape(-1, 2).T
        first = np.searchsorted(word_of, np.arange(len(words) + 1))

        def winners(ends: np.ndarray, data: np.ndarray) -> list[dict | None]:
            text, word = finder.find(ends, data)
            won: list[dict | None] = [None] * (len(ends) - 1)
            for low, high in _parts(np.cumsum(np.bincount(text, (first[1:] - first[:-1])[word], len(won))), PAIRS):
                some = slice(*np.searchsorted(text, [low, high]))
                times = first[word[some] + 1] - first[word[some]]
                hit = np.repeat(np.arange(some.start, some.stop), times)
                rule = rules[first[word[hit]] + np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times)]
                keys, counts = np.unique(text[hit] * len(order) + rule, return_counts=True)
                best = np.lexsort((keys, -counts, keys // max(1, len(order))))
                best = best[np.unique(keys[best] // max(1, len(order)), return_index=True)[1]]
                chosen = np.full(len(won), -1)
                chosen[keys[best] // max(1, len(order))] = keys[best] % max(1, len(order))
                terms: dict[int, list[str]] = {}
                for t, w in zip(*(a[hit[chosen[text[hit]] == rule]].tolist() for a in (text, word))):
                    terms.setdefault(t, []).append(finder.words[w].decode())
                for t, n in zip((keys[best] // max(1, len(order))).tolist(), counts[best].tolist()):
                    rule_id = order[chosen[t]]
                    if rule_id is not None:
                        won[t] = dict(zip(("category", "subcategory"), of[rule_id])) | {"hits": n, "terms": ", ".join(terms[t])}
            return won

        for column in texts:
            column = column.cast(pa.string())
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1].astype(np.int64) if len(column) else []
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if len(column) else np.empty(0, np.uint8)
            won = []
            for low, high in _parts(np.cumsum(np.diff(ends)), TEXT_BYTES) if len(column) else ():
                won += winners(ends[low : high + 1] - ends[low], data[ends[low] : ends[high]])
            yield pa.array(won, pa.struct([("category", pa.string()), ("subcategory", pa.string()), ("hits", pa.int32()), ("terms", pa.string())]))

    search.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = F.arrow_udf(search, "category string, subcategory string, hits int, terms string")
    # Like the inline winner, past a generator: no filter on the outcome moves below the search.
    return texts.withColumn("_found", F.explode(F.array(found("_text")))).withColumn("_won", F.struct("_found.hits", is_blank(F.col("_text")).alias("blank"), "_found.category",
                                           "_found.subcategory", "_found.terms"))


def classify_indexed(df: DataFrame, text_col: str, rules: DataFrame, *, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """What ``classify`` gives, for rules in a table ``rule, category, subcategory, keyword`` of any length.

    Each text is looked up in the index by its own runs of characters; only keywords found that way are
    searched in it. An index up to ``index_bytes``, with the names of its rules, is sent to every task, and
    the texts stay where they are; a larger one is joined by a shuffle of the runs, the texts stored and
    shuffled once.
    """
    index = stage(keyword_index(rules))
    names = rules.groupBy("rule").agg(F.first("category").alias("category"), F.first("subcategory").alias("subcategory"))
    named = stage(names.join(index.select("rule").distinct(), "rule"))
    entry = F.octet_length("keyword") + F.octet_length("gram") + 64
    told = F.coalesce(F.octet_length("category"), F.lit(0)) + F.coalesce(F.octet_length("subcategory"), F.lit(0)) + 64
    size, kinds = index.agg(F.sum(entry), F.collect_set(F.length("gram"))).first()
    lowered = F.coalesce(F.lower(F.col(text_col)), F.lit(""))
    plain = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), lowered.alias("_text"))
    if (size or 0) + (named.agg(F.sum(told)).first()[0] or 0) <= index_bytes:
        return _with_outcome(_winner_by_index(plain, index, named).select("_row.*", "_won"), df.columns)
    texts = stage(plain.withColumn("_id", F.monotonically_increasing_id()))
    looked = texts.select("_id", "_text", F.explode(_grams(F.col("_text"), sorted(kinds) or [GRAM])).alias("gram"))
    hits = looked.join(index, "gram").where(F.contains("_text", "keyword")).groupBy("_id", "rule").agg(
        F.count(F.lit(1)).cast("int").alias("hits"), F.array_sort(F.collect_list("keyword")).alias("terms"))
    best = hits.groupBy("_id").agg(F.max(F.struct("hits", (-F.col("rule")).alias("order"), "terms")).alias("best"))
    won_by = best.join(named, F.col("rule") == -F.col("best.order")).select(
        F.col("_id").alias("_of"), F.col("best.hits").alias("hits"), "category", "subcategory", F.array_join("best.terms", ", ").alias("terms"))
    won = F.struct("hits", is_blank(F.col("_text")).alias("blank"), "category", "subcategory", "terms")
    return _with_outcome(texts.join(won_by, F.col("_id") == F.col("_of"), "left").withColumn("_won", won).select("_row.*", "_won"), df.columns)
