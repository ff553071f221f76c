"""Problem 3: text cut off by field limits.

Per source and unit of length (code points, bytes) the discrete hazard of each
length - how many texts end there of all that get as far - is compared with the
hazards of the lengths around it; lengths whose excess survives
Benjamini-Hochberg are limits.  At a limit the excess gives the odds that a
text of that length was cut there: of ``n`` texts ``expected`` would have ended
anyway.

A text is cut if it stops inside a structure (fence, JSON value, card,
quotation, bracket, clause, word), or if the log-odds of a whole last sentence
that the ending model gives do not reach the log-odds of a cut that its length
gives.  ``by`` names what decided: a ``limit`` (the length is one and the
ending incomplete), elsewhere the ``structure`` or the ``model``; ``needed`` is
true where the ending alone, at another length, would have passed as whole.

Defined results: null and blank contents are never cut; a repeated row counts
once; a null source is a source of its own.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkloom.llm import endings
from inkloom.operators.ranking import global_row_number
from inkloom.session import cut, table

#: Lengths on either side that a length's hazard is compared with.
NEIGHBOURS = 40
#: Expected share of false limits.
FALSE_DISCOVERY = 0.01
#: Log-odds of a cut that a reason which names a length gives, and an ellipsis after an ending without stop.
SAID_LENGTH, DOTTED = 1.0, 3.0
#: Share of the cards of one layout that end with a key, or a line, for it to be a last one.
LAST_KEY_SHARE = 0.2

# Reasons that mean a length limit, in lower case.
LENGTH_REASONS = ["length", "max_tokens", "max_output_tokens", "model_length", "token_limit", "incomplete"]


def hazards(lengths: DataFrame) -> DataFrame:
    """``source, unit, length, n, expected, log_p`` of the lengths with an excess, from ``source, unit, length``.

    The tail of the Poisson distribution is bounded by Chernoff's inequality,
    so ``log_p`` is never too small.
    """
    counts = lengths.groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    own = W.partitionBy("source", "unit")
    at_risk = F.sum("n").over(own.orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, 0))
    risky = counts.withColumn("at_risk", at_risk)
    near = own.orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    ends, risks = F.sum("n").over(near) - F.col("n"), F.avg("at_risk").over(near) * (2 * NEIGHBOURS)
    # Half an ending more, so that an empty neighbourhood proves nothing.
    rate = (ends + 0.5) / F.greatest(risks, F.lit(1.0))
    found = risky.withColumn("expected", rate * F.col("at_risk")).filter(F.col("n") > F.col("expected"))
    log_p = -(F.col("n") * F.log(F.col("n") / F.col("expected")) - F.col("n") + F.col("expected"))
    return found.select("source", "unit", "length", "n", "expected", log_p.alias("log_p"))


def limits(lengths: DataFrame, false_discovery: float = FALSE_DISCOVERY) -> DataFrame:
    """The lengths that are significant at the given false-discovery rate."""
    tested = hazards(lengths)
    # All lengths that could be tested count as tests; the table holds one row per source and length in excess.
    m = lengths.select("source", "unit", "length").distinct().agg(F.greatest(F.count("*"), F.lit(1)).alias("m"))
    ranked = global_row_number(tested, ["log_p", "source", "unit", "length"], "rank").join(F.broadcast(m))  # one row
    passed = F.col("log_p") <= F.log(F.col("rank") * F.lit(false_discovery) / F.col("m"))
    last = ranked.agg(F.max(F.when(passed, F.col("rank"))).alias("last"))
    return ranked.join(F.broadcast(last)).filter(F.col("rank") <= F.col("last")).select("source", "unit", "length", "n", "expected", "log_p")  # one row


def structure(df: DataFrame) -> DataFrame:
    """Add ``kind`` (blank, json, card, prose), ``cut`` by structure and ``doubt`` where the ending model is asked, to ``content``."""
    trimmed = F.regexp_replace(F.coalesce(F.col("content"), F.lit("")), r"^[\s\p{Cf}]+|[\s\p{Cf}]+$", "")
    df = df.withColumn("_text", trimmed)
    text = F.col("_text")
    json_like = text.rlike(r"^(?:[^\n{\[`]{0,200}\n+)?\s*(?:```\w*\s*)?[{\[]\s*(?:[\"{\[\]}]|\z)") | text.rlike(r"^(?:[^\n{\[`]{0,200}\n+)?\s*```\w*\s*\z")
    card = text.rlike(r"^\p{L}[\p{L}\p{N}_ ]{0,30}: [^\n]*(?:\n\p{L}[\p{L}\p{N}_ ]{0,30}: ?[^\n]*)+(?:\n\p{L}*)?\z")
    # Closing marks of a whole text: rules, tags, notes in brackets, pictures.
    df = df.withColumn("kind", F.when(text == "", "blank").when(json_like, "json").when(card, "card").otherwise("prose"))
    closed = text.rlike(r"(?:\n\s*(?:-{2,}|={2,}|\*{3,}|~{2,}|_{3,}|#{2,})|\n\s*<[^<>\n]{1,40}>|\n\s*\*\([^()\n]{1,60}\)\*|\n\s*[\[(（【][^\[\]()（）【】\n]{1,40}[\])）】]|[\x{2190}-\x{2bff}\x{1f000}-\x{1faff}]\x{fe0f}?)\z")
    plain = F.regexp_replace(F.regexp_replace("_text", r"(?s)\\.", ""), r'"[^"]*"', "''")
    df = df.withColumns({"_closed": closed, "_plain": F.when(F.col("kind") == "json", plain), "_fences": F.regexp_count(text, F.lit("```"))})

    def more(a: str, b: str) -> Column:
        return F.length(F.regexp_replace("_plain", f"[^{a}]+", "")) > F.length(F.regexp_replace("_plain", f"[^{b}]+", ""))

    json_cut = F.contains(F.col("_plain"), F.lit('"')) | more(r"\{", r"\}") | more(r"\[", r"\]") | text.rlike(r"\\\z")
    fence_cut = (F.col("_fences") % 2 == 1) | text.rlike(r"(?:^|[^`])`{1,2}\z")
    broken = text.rlike(r"[\x{fffd}]\z")
    # An ellipsis after an unfinished sentence is a mark of the cut, so the text before it is judged.
    dash = text.rlike(r"[—–―]\z")
    pending = text.rlike(r"[,，、;；:：\-‐‑(（「『“„¿¡]\s*(?:…|\.{3,})?\z") & ~dash & ~F.col("_closed")
    open_ = endings.unclosed(text) & ~dash & ~F.col("_closed")
    whole = F.col("_closed") | dash | (endings.stopped(text) & ~text.rlike(r"(?:…|\.{3,})\z")) | text.rlike(r"[\"”’“』」»）)】\]*]\z")
    cut_ = F.when(F.col("kind") == "blank", False).when(fence_cut | broken, True).when(F.col("kind") == "json", json_cut).when(F.col("kind") == "card", False).otherwise(pending | open_ | (~whole & endings.stops_before(text)))
    df = df.withColumn("cut", F.coalesce(cut_, F.lit(False)))
    return df.withColumn("doubt", (F.col("kind") == "prose") & ~F.col("cut") & ~whole).drop("_closed", "_plain", "_fences")


def _judge(model: endings.EndingModel):
    def run(batches):
        for batch in batches:
            cut_, tails, odds, piece, limit = (batch.column(i).to_pylist() for i in (1, 2, 3, 4, 5))
            by, needed = ["structure" if c else None for c in cut_], [False] * len(cut_)
            at = [i for i, t in enumerate(tails) if t is not None]
            for i, s in zip(at, model.score([tails[i] for i in at])):
                if piece[i]:
                    by[i] = "structure"
                elif s <= odds[i]:
                    by[i], needed[i] = "model", bool(s > odds[i] - limit[i])
            kept = [i for i, b in enumerate(by) if b]
            out = ["limit" if limit[i] > 0 else by[i] for i in kept]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(out, pa.string()), pa.array([needed[i] for i in kept], pa.bool_())], ["output_id", "by", "needed"])

    return run


class CutOff:
    """Which outputs are cut, and at which lengths each source cuts; ``outputs`` has output_id, source, content, reason.

    ``found`` is ``output_id, by, needed``, one row per cut output.  The texts
    are read once: what is needed of each goes to a narrow table.
    """

    def __init__(self, outputs: DataFrame, sample: int = endings.SAMPLE_TEXTS):
        outputs = outputs.select("output_id", "source", "content", "reason")
        share = endings.sample_share(outputs.count(), sample)
        h = F.xxhash64("output_id", "_text")
        shaped = structure(outputs.withColumns({"chars": F.coalesce(F.length("content"), F.lit(0)), "bytes": F.coalesce(F.octet_length("content"), F.lit(0))}))
        dotted = F.col("_text").rlike(r"(?:…|\.{3,})\z")
        lines = F.split("_text", "\n")
        tail = F.when(F.col("doubt"), F.expr(r"right(regexp_replace(_text, '\\s*(?:…|\\.{3,})$', ''), 400)"))
        sampled = (F.col("kind") == "prose") & endings.drawn(F.col("_h"), share) & endings.stopped(F.col("_text"))
        narrow = shaped.withColumn("_h", h).select("output_id", "source", "chars", "bytes", F.coalesce(F.lower(F.trim("reason")).isin(LENGTH_REASONS), F.lit(False)).alias("said_length"), dotted.alias("dotted"), "cut", tail.alias("tail"), F.when(F.col("kind") == "card", F.struct(F.regexp_extract(lines[0], r"^([^:]{1,40}):", 1).alias("layout"), F.element_at(lines, -1).alias("line"))).alias("card"), F.when(sampled, F.struct(endings.passage(F.col("_text"), F.abs(F.xxhash64("_h"))).alias("t"), F.col("_h").alias("h"))).alias("passage"), F.col("_h").alias("form"))
        self.shaped = cut(narrow, "shaped")
        once = self.shaped.dropDuplicates(["output_id", "source", "form", "said_length"])
        units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))
        self.limits = cut(limits(once.filter("chars > 0").select("source", units.alias("x")).select("source", "x.unit", "x.length")), "limits")
        model = endings.train(endings.least_passages(self.shaped.filter("passage is not null").select("passage.t", "passage.h"), sample))
        judged = self._doubtful_cards(self.shaped)
        for unit in ("chars", "bytes"):
            own = self.limits.filter(F.col("unit") == unit).select(F.col("source").alias("_s"), F.col("length").alias("_l"), F.log((F.col("n") - F.col("expected")) / F.col("expected")).alias(f"at_{unit}"))
            judged = judged.join(own, judged["source"].eqNullSafe(own["_s"]) & (judged[unit] == own["_l"]), "left").drop("_s", "_l")
        limit = F.greatest(F.coalesce("at_chars", F.lit(0.0)), F.coalesce("at_bytes", F.lit(0.0)), F.lit(0.0))
        odds = limit + F.when(F.col("said_length"), F.lit(SAID_LENGTH)).otherwise(0.0) + F.when(F.col("dotted"), F.lit(DOTTED)).otherwise(0.0)
        # The words inside all texts tell a piece of a word.
        asked = judged.withColumn("word", F.coalesce(endings.last_word(F.col("tail")), F.lit("")))
        pieces = endings.pieces_of_words(asked, endings.inner_words(outputs, "content")).withColumn("piece", F.lit(True))
        asked = asked.join(pieces, "word", "left").select("output_id", "cut", "tail", odds.alias("odds"), F.coalesce("piece", F.lit(False)).alias("piece"), limit.alias("limit"))
        self.found = asked.mapInArrow(_judge(model), "output_id bigint, by string, needed boolean").groupBy("output_id").agg(F.min("by").alias("by"), F.min("needed").alias("needed"))

    @staticmethod
    def _doubtful_cards(shaped: DataFrame) -> DataFrame:
        """Mark the cards that stop before a usual last key of their layout, or inside a usual last line; other last values than the usual ones go to the ending model.

        Cards with the same first key are of one layout.
        """
        cards = shaped.filter("card is not null").select("card.layout", "card.line").withColumn("key", F.regexp_extract("line", r"^([^:]{1,40}):", 1))
        total = cards.groupBy("layout").agg(F.count("*").alias("cards"))
        usual_keys = cards.groupBy("layout", "key").agg(F.count("*").alias("n")).join(total, "layout").filter(F.col("n") >= F.col("cards") * LAST_KEY_SHARE).select(F.col("layout").alias("_layout"), F.col("key").alias("_key"), F.lit(True).alias("_usual"))
        # At most 1 / share lines a layout.
        usual_lines = cards.groupBy("layout", "line").agg(F.count("*").alias("n")).join(total, "layout").filter(F.col("n") >= F.col("cards") * LAST_KEY_SHARE).groupBy("layout").agg(F.collect_list("line").alias("_lines")).withColumnRenamed("layout", "_of")
        rows = shaped.withColumn("_line_key", F.regexp_extract("card.line", r"^([^:]{1,40}):", 1))
        rows = rows.join(usual_keys, (rows["card.layout"] == usual_keys["_layout"]) & (rows["_line_key"] == usual_keys["_key"]), "left")
        rows = rows.join(usual_lines, rows["card.layout"] == usual_lines["_of"], "left")
        line = F.col("card.line")
        lines = F.coalesce("_lines", F.array().cast("array<string>"))
        part = F.exists(lines, lambda x: (F.length(x) > F.length(line)) & x.startswith(line))
        is_card = F.col("card").isNotNull()
        stops_short = is_card & (F.col("_usual").isNull() | part)
        odd = is_card & ~stops_short & ~F.array_contains(lines, line) & ~endings.stopped(line)
        value = F.regexp_extract("card.line", r"^[^:]{1,40}:\s*(.*)$", 1)
        return rows.withColumns({"cut": F.col("cut") | F.coalesce(stops_short, F.lit(False)), "tail": F.when(F.coalesce(odd, F.lit(False)), F.right(value, F.lit(400))).otherwise(F.col("tail"))}).drop("_line_key", "_layout", "_key", "_usual", "_of", "_lines")


def _outputs(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "llm_outputs").select("output_id", F.col("model").alias("source"), "content", F.col("finish_reason").alias("reason"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    return CutOff(_outputs(spark, sf_dir)).found.select("output_id")


def p3_evidence(spark, sf_dir: str) -> DataFrame:
    """``output_id, by, needed``: what decided that an output is cut."""
    return CutOff(_outputs(spark, sf_dir)).found


def p3_rates(spark, sf_dir: str) -> DataFrame:
    """``model, outputs, cut_outputs, cut_share``."""
    work = CutOff(_outputs(spark, sf_dir))
    marked = work.shaped.select("output_id", "source").distinct().join(work.found.select("output_id", F.lit(1).alias("cut")), "output_id", "left")
    return marked.groupBy(F.col("source").alias("model")).agg(F.count("*").alias("outputs"), F.coalesce(F.sum("cut"), F.lit(0)).alias("cut_outputs"), (F.coalesce(F.sum("cut"), F.lit(0)) / F.count("*")).alias("cut_share"))


def p3_limits(spark, sf_dir: str) -> DataFrame:
    return CutOff(_outputs(spark, sf_dir)).limits.withColumnRenamed("source", "model")
