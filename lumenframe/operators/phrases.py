"""Phrases of a vocabulary in many texts at once, roles of what they say in a question, and the question's branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What results depend on in questions that are answered by yes or no.
AUXILIARIES = "is are was were do does did can could has have will would should may might must".split()
PREDICATES = "hold holding carry carrying wear wearing say says show shows display displays read reads contain contains cầm giữ mang đeo đội mặc".split()
# The vocabulary of questions, by category and name (English and Vietnamese).
VOCABULARY: dict[str, dict[str, list[str]]] = {
    "subject": {
        "người dẫn chương trình": ["người dẫn chương trình", "người dẫn"], "người đi xe đạp": ["người đi xe đạp"], "người phụ nữ": ["người phụ nữ"], "người đàn ông": ["người đàn ông"], "cô gái": ["cô gái"], "chàng trai": ["chàng trai"],
        "đứa trẻ": ["đứa trẻ", "trẻ em"], "woman": ["the woman", "a woman", "woman"], "man": ["the man", "a man", "man"], "child": ["the child", "a child", "child"], "person": ["the person", "a person", "person"],
        "runner": ["the runner", "a runner", "runner"], "cyclist": ["the cyclist", "a cyclist", "cyclist"], "người": ["người"],
    },
    "objects": {
        "cabin cáp treo": ["cabin cáp treo"], "đèn lồng": ["những chiếc đèn lồng", "các chiếc đèn lồng", "chiếc đèn lồng", "đèn lồng"], "lan can": ["lan can"], "bức tượng": ["hai bức tượng", "bức tượng", "tượng"], "chòi": ["các chòi", "những chòi", "chòi"],
        "nồi đen": ["chiếc nồi đất đen", "nồi đất đen", "nồi đen"], "bát trắng": ["chiếc bát trắng", "bát trắng"], "mũ bảo hiểm": ["mũ bảo hiểm"], "đèn giao thông": ["đèn giao thông"], "traffic light": ["the traffic light", "a traffic light", "traffic light"],
        "chiếc ô": ["chiếc ô", "cái ô"], "biển hiệu": ["biển hiệu"], "chiếc cốc": ["chiếc cốc", "cái cốc"], "con mèo": ["con mèo"], "con chó": ["con chó"], "bicycles": ["the bicycles", "bicycles"], "bicycle": ["a bicycle", "the bicycle", "bicycle"],
        "suitcase": ["the suitcase", "a suitcase", "suitcase"], "car": ["the car", "a car", "car"], "bib": ["the runner's bib", "runner's bib", "the bib", "bib"], "phone": ["a phone", "the phone", "phone"], "book": ["a book", "the book", "book"],
        "ball": ["a ball", "the ball", "ball"], "sign": ["a sign", "the sign", "sign"], "jacket": ["a jacket", "the jacket", "jacket"], "bag": ["a bag", "the bag", "bag"], "túi": ["cái túi", "chiếc túi", "túi"], "cup": ["a cup", "the cup", "cup"], "helmet": ["a helmet", "the helmet", "helmet"],
    },
    "attributes": {
        "đồng phục phản quang": ["đồng phục phản quang"], "áo đỏ": ["áo đỏ"], "blue shirt": ["the blue shirt", "a blue shirt", "blue shirt"], "xanh lá": ["xanh lá"], "xanh dương": ["xanh dương"], "đỏ": ["đỏ"], "vàng": ["vàng"], "đen": ["đen"], "trắng": ["trắng"],
        "green": ["green"], "blue": ["blue"], "red": ["red"], "yellow": ["yellow"], "black": ["black"], "white": ["white"],
    },
    "actions": {
        "directing traffic": ["directing traffic"], "đi bộ": ["đi bộ"], "cầm": ["cầm"], "giữ": ["giữ"], "mang": ["mang"], "nằm": ["nằm"], "ngồi": ["ngồi"], "đứng": ["đứng"], "chạy": ["chạy"], "nấu": ["nấu"], "ăn": ["ăn"], "uống": ["uống"],
        "holding": ["holding"], "hold": ["hold"], "carrying": ["carrying"], "carry": ["carry"], "wearing": ["wearing"], "wear": ["wear"], "sitting": ["sitting"], "standing": ["standing"], "walking": ["walking"], "running": ["running"], "cooking": ["cooking"], "eating": ["eating"], "drinking": ["drinking"],
    },
    "locations": {
        "phía trên cửa": ["phía trên cửa"], "cạnh cửa": ["cạnh cửa"], "bên trái": ["bên trái"], "bên phải": ["bên phải"], "trên bàn": ["trên bàn"], "by the tree": ["by the tree"], "next to the window": ["next to the window"], "beside the wall": ["beside the wall"], "at the intersection": ["at the intersection"],
    },
}
#: Categories whose phrases the object phrases must not overlap.
EXCLUDED = {"objects": ("locations", "subject")}
#: Categories that a tested value may come from, where a question has no verb of its own.
TESTED = ("attributes", "ocr_terms", "locations", "objects")

BETWEEN = r"(?U)(?<=\w)(?=\W)|(?<=\W)(?=\w)"


def vocabulary(spark: SparkSession, known: dict[str, dict[str, list[str]]] = VOCABULARY) -> DataFrame:
    """(category, canonical, variant) of a vocabulary."""
    return spark.createDataFrame([(c, name, v) for c, names in known.items() for name, variants in names.items() for v in variants], "category string, canonical string, variant string")


def pieces(text: Column) -> Column:
    """A lower-cased text cut into runs of word characters and runs of others; joined they are the text."""
    return F.split(F.lower(text), BETWEEN)


def candidates(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, category, canonical, start, end) of every place where a variant stands between word boundaries, in
    characters from 0. texts: query_id, text; phrases: category, canonical, variant (beginning and ending in word characters).

    Texts and variants are cut the same way, so a variant stands where as many pieces in a row are equal to it: an equi-join.
    """
    known = phrases.select("category", "canonical", F.lower("variant").alias("variant")).where("variant <> ''").withColumn("_n", F.size(pieces(F.col("variant"))))
    sizes = [r["_n"] for r in known.select("_n").distinct().orderBy("_n").collect()]  # lengths of phrases: a few small numbers
    cut = texts.select("query_id", pieces(F.coalesce("text", F.lit(""))).alias("_p"))
    spots = cut.select("query_id", "_p", F.posexplode("_p").alias("_i", "_piece"))
    before = Window.partitionBy("query_id").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    spots = spots.withColumn("start", F.coalesce(F.sum(F.length("_piece")).over(before), F.lit(0)).cast("int"))
    runs = F.array(*[F.struct(F.lit(n).alias("_n"), F.array_join(F.slice("_p", F.col("_i") + 1, n), "").alias("variant")) for n in sizes]) if sizes else F.array().cast("array<struct<_n:int,variant:string>>")
    each = spots.select("query_id", "start", F.explode(runs).alias("r")).select("query_id", "start", "r._n", "r.variant")
    return each.join(known, ["_n", "variant"]).select("query_id", "category", "canonical", "start", (F.col("start") + F.length("variant")).alias("end"))


def longest(found: DataFrame) -> DataFrame:
    """Of candidates, for each query and category, those that a choice of the longest first, then the earliest, then by name
    leaves without overlap. Places that don't touch are chosen apart, so no group is longer than a run of overlapping phrases."""
    order = Window.partitionBy("query_id", "category").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    parts = found.withColumn("_new", F.when(F.col("start") < F.max("end").over(order), 0).otherwise(1))
    islands = parts.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = F.struct((F.col("start") - F.col("end")).alias("less"), "start", "canonical", "end")
    held = islands.groupBy("query_id", "category", "_island").agg(F.array_sort(F.collect_set(one)).alias("c"))

    def choose(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate("c", F.slice("c", 1, 0), choose)
    return held.select("query_id", "category", F.explode(kept).alias("k")).select("query_id", "category", "k.canonical", "k.start", "k.end")


def constraints(texts: DataFrame, phrases: DataFrame, excluded: dict[str, tuple[str, ...]] = EXCLUDED) -> DataFrame:
    """(query_id, category, canonical, start, end, place): the phrases of each text, chosen by category; those of a category in
    ``excluded`` can't overlap with what its named categories chose. place numbers a category's different phrases by appearance."""
    found = candidates(texts, phrases)
    free = found.where(~F.col("category").isin(list(excluded)))
    chosen = longest(free)
    for category, others in excluded.items():
        taken = chosen.where(F.col("category").isin(*others)).select("query_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
        own = found.where(F.col("category") == category)
        clash = own.join(taken, "query_id").where((F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end"))).select("query_id", "category", "canonical", "start", "end").distinct()
        chosen = chosen.unionByName(longest(own.join(clash, ["query_id", "category", "canonical", "start", "end"], "left_anti")))
    first = chosen.groupBy("query_id", "category", "canonical").agg(F.min(F.struct("start", "end")).alias("f"))
    place = F.row_number().over(Window.partitionBy("query_id", "category").orderBy("f.start", "f.end"))
    return first.select("query_id", "category", "canonical", "f.start", "f.end", place.alias("place"))


def hypothesis_starts(questions: DataFrame, known: DataFrame) -> DataFrame:
    """(query_id, anchor, hypothesis): where the tested proposition of each English yes-or-no question (query_id, text) begins.

    After the auxiliary, and what it begins with "there is": there. Else the anchor is the first subject, or object, and the
    proposition begins at the first action after it, else at a predicate verb, else at the first other phrase of a tested
    category; null where nothing is tested.
    """
    text = F.lower(F.coalesce("text", F.lit("")))
    aux = F.length(F.regexp_extract(text, rf"^\s*(?:{'|'.join(AUXILIARIES)})\b", 0))
    there = F.length(F.regexp_extract(F.substr(text, aux + 1), r"^\s+there\b", 0))
    rows = questions.select("query_id", text.alias("_t"), aux.alias("_aux"), F.when((aux > 0) & (there > 0), aux + there).alias("_there"))
    spans = known.select("query_id", "category", "start", "end")
    met = rows.join(spans, "query_id", "left")
    span = F.struct("start", "end")
    pick = lambda c: F.min(F.when((F.col("category") == c) & (F.col("start") >= F.col("_aux")), span))
    anchors = met.groupBy("query_id", "_t", "_aux", "_there").agg(F.coalesce(pick("subject"), pick("objects")).alias("_a"))
    anchors = anchors.withColumn("_from", F.coalesce("_a.end", "_aux"))
    after = anchors.join(spans, "query_id", "left").where("start IS NULL OR start >= 0")
    verb = F.regexp_instr(F.substr("_t", F.col("_from") + 1), F.lit(rf"(?U)\b(?:{'|'.join(PREDICATES)})\b"))
    later = F.col("start") >= F.col("_from")
    told = after.groupBy("query_id", "_t", "_there", "_a", "_from").agg(
        F.min(F.when((F.col("category") == "actions") & later, F.col("start"))).alias("_act"), F.min(F.when(F.col("category").isin(*TESTED) & later & ~F.col("start").eqNullSafe(F.col("_a.start")), F.col("start"))).alias("_value"),
    )
    at = F.coalesce("_there", "_act", F.when(verb > 0, F.col("_from") + verb - 1), "_value")
    return told.select("query_id", F.col("_a.start").alias("anchor"), at.alias("hypothesis"))


def with_roles(known: DataFrame, starts: DataFrame) -> DataFrame:
    """Append role to constraints: hypothesis for those that stand in the tested proposition of a question in ``starts`` (they
    must not raise a hit's relevance), else context."""
    told = known.join(starts.select("query_id", "hypothesis"), "query_id", "left")
    return told.withColumn("role", F.when(F.col("start") >= F.col("hypothesis"), "hypothesis").otherwise("context")).drop("hypothesis")


def branches(questions: DataFrame, starts: DataFrame) -> DataFrame:
    """(query_id, branch, text) of questions (query_id, text): the question as it is, and for those in ``starts`` with a
    proposition the neutral context before it and the proposition itself. Empty branches are left out."""
    aux = rf"(?i)^\s*(?:{'|'.join(AUXILIARIES)})\b\s*"
    rows = questions.select("query_id", F.coalesce("text", F.lit("")).alias("t")).join(starts.select("query_id", "hypothesis"), "query_id", "left")
    clean = lambda c: F.trim(F.regexp_replace(c, r"[\s?!.,;:]+$", ""))
    before = clean(F.regexp_replace(F.substr("t", F.lit(1), F.col("hypothesis")), aux, ""))
    each = F.array(F.struct(F.lit("question").alias("branch"), F.trim("t").alias("text")), F.struct(F.lit("context").alias("branch"), before.alias("text")), F.struct(F.lit("proposition").alias("branch"), clean(F.substr("t", F.col("hypothesis") + 1)).alias("text")))
    return rows.select("query_id", F.explode(each).alias("b")).select("query_id", "b.branch", "b.text").where("text <> ''")
