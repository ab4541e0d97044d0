"""Benchmark decontamination by template canonicalisation [native].

Numbers, units and names are replaced with typed placeholders, so that a question
with other parameters has the same template; a unit or name of several words is one
placeholder.  Windows of ``window`` words of the
documents' templates are hash-joined with those of the benchmark's.  Windows of a
pair that lie at the same shift are one alignment; it counts only if its slots
are consistent: each value of a benchmark slot stands for one value throughout, and
for no other one than in the alignment with the most windows.
A document holds an item if consistent alignments cover at least ``similarity``
of the item's distinct windows.  All this is done for two forms of the texts: the
whole template, and one made of the text in lower case, without names, as names
can't be told from other words in a text in capitals; either will do.

A window of placeholders alone is no evidence: there the numbers' own values count, so
a table of numbers holds only an item of the same numbers.

A capitalised word is a name only after a small letter, a number, a comma or a
semicolon: one that begins a sentence is a word like others, so where it is changed
the windows that hold it are lost.  An item of fewer words than a window is one window,
which a document holds only if it is as short.

The benchmark's windows are broadcast only when counted few; beyond that the
join is shuffled.

Defined cases: null and empty texts have no windows; a text shorter than a window
is one window; repeated rows and items give pairs as often as distinct (doc_id,
item_id) pairs; the texts of rows that share a doc_id count together; ties between
alignments go to the smaller shift; null ids give no pair; other columns are ignored;
empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxstrata.llm.common import written
from voxstrata.llm.components import sized

#: Units that may follow a number.
UNITS = "km kg mg cm mm ml mph kmh m g l s h %".split() + "meter meters metre metres mile miles foot feet inch inches pound pounds ounce ounces gram grams liter liters hour hours minute minutes second seconds day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees".split()


_UNIT = "(?:" + "|".join(sorted(UNITS, key=len, reverse=True)) + ")"
_ENDED = rf"{_UNIT}(?![\p{{L}}\p{{N}}<])"
# repeated groups are possessive: others take a frame of the stack for each round, so long runs would overflow it
_UNITS = rf"{_ENDED}(?:(?: per |[ /]){_ENDED})*+"
_NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*+"
_NAME = r"\p{Lu}\p{L}[\p{L}'’-]*"
_NAMES = f"{_NAME}(?: {_NAME})*+"


def _plain(text: Column, names: bool) -> Column:
    """The text without what looks like a placeholder; without names, in lower case."""
    # translate() looks each character up in a map, which takes as long as two patterns
    blank = lambda t, c: F.replace(t, F.lit(c), F.lit(" "))
    return blank(blank(text if names else F.lower(text), "<"), ">")


def _replaced(text: Column, names: bool, number: str, kind: str) -> Column:
    """Numbers, units and names replaced; a pattern begins with the character that is tested first, as most places fail there."""
    t = F.regexp_replace(_plain(text, names), _NUMBER, number)
    t = F.regexp_replace(t, rf"({kind}) ?{_UNITS}", "$1 <u>")
    if names:
        t = F.regexp_replace(t, rf"([\p{{Ll}}0-9,;>] ){_NAMES}", "$1<p>")
    return F.regexp_replace(F.lower(t), r"""[.,;:!?"')\]](?<=[\p{L}\p{N}>].)[.,;:!?"')\]]*(?!\S)|["'(\[](?<!\S.)["'(\[]*(?=[\p{L}\p{N}<])""", "")


def template(text: Column, names: bool = True) -> Column:
    """The text with placeholders <n>, <u>, <p>, in lower case, without punctuation at words' ends.

    Without names there is no <p>, and letter case makes no difference."""
    return _replaced(text, names, "<n>", "<n>")


def _valued(text: Column, names: bool) -> Column:
    """The template with each number's value in its placeholder, as <n:12>; it has the same words."""
    return _replaced(text, names, "<n:$0>", "<n:[^<>]*>")


def slot_values(text: Column, names: bool = True) -> Column:
    """What the template's placeholders stand for, in order."""
    return F.regexp_extract_all(_plain(text, names), F.lit(rf"{_NUMBER}|(?<=[0-9]) ?{_UNITS}" + rf"|(?<=[\p{{Ll}}0-9,;%] ){_NAMES}" * names), F.lit(0))


def slots(text: Column, names: bool = True) -> Column:
    """(word, nth, value) of each placeholder: the template's word that it is in, and which of that word's it is."""
    count = lambda w: F.length(w) - F.length(F.replace(w, F.lit("<"), F.lit("")))
    places = F.transform(word_list(template(text, names)), lambda w, i: F.transform(F.array_repeat(i, count(w)), lambda i, k: F.struct(i.alias("word"), k.alias("nth"))))
    bare = lambda c: F.regexp_replace(F.lower(c), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.transform(F.arrays_zip(F.flatten(places).alias("at"), slot_values(text, names).alias("value")), lambda s: F.struct(s["at"]["word"].alias("word"), s["at"]["nth"].alias("nth"), bare(s["value"]).alias("value")))


def word_list(text: Column) -> Column:
    return F.split(F.trim(text, F.lit("\t\n\r\x0b\x0c ")), r"[\t-\r ]+")


def _once(c: Column, f) -> Column:
    """f(c), with c made once: it is bound to a lambda's variable."""
    return F.transform(F.array(c), f)[0]


def _rolled(ws: Column, window: int) -> Column:
    """A hash of each `window` words of a list of as many or more, by place: words are hashed once, runs of them from the hashes of their halves."""
    two = lambda a, b, shift: F.zip_with(a, F.slice(b, shift + 1, F.size(b) - shift), lambda x, y: F.xxhash64(x, y))

    def grown(h: Column, words: Column, width: int, bits: str) -> Column:
        """From the hashes of `width` words, by the digits of `window` that are left."""
        if not bits:
            return F.slice(h, 1, F.size(words) - (window - 1))
        if bits[0] == "0":
            return _once(two(h, h, width), lambda d: grown(d, words, 2 * width, bits[1:]))
        return _once(two(h, h, width), lambda d: _once(two(d, words, 2 * width), lambda o: grown(o, words, 2 * width + 1, bits[1:])))

    return _once(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: grown(h, h, 1, f"{window:b}"[1:]))


def _windows(text: Column, names: bool, window: int) -> Column:
    """Hashes of the windows of a text's template; a shorter template is one window.  Windows of placeholders alone are hashed with their numbers.

    A placeholder may have one character before it, as in $5."""
    bare = lambda ws: F.forall(ws, lambda w: w.rlike(r"^\S?<"))
    whole = lambda ws, vs: F.array(F.xxhash64(F.when(bare(ws), vs).otherwise(ws)))
    told = lambda ws, vs: _once(_rolled(vs, window), lambda v: F.transform(_rolled(ws, window), lambda h, i: F.when(bare(F.slice(ws, i + 1, window)), v[i]).otherwise(h)))
    somewhere = rf"<(?<!\S\S<)(?:\S*+\s++\S?<){{{window - 1}}}"
    # bound to a lambda's variable, a list is made once for a text and not once for a window; numbers are looked at only where such a window is
    lists = lambda t: F.transform(F.array(word_list(t)), lambda ws: F.struct(ws.alias("ws"), F.when((F.size(ws) < window) | t.rlike(somewhere), word_list(_valued(text, names))).alias("vs")))
    hashed = lambda s: F.when(F.size(s["ws"]) < window, whole(s["ws"], s["vs"])).when(s["vs"].isNull(), _rolled(s["ws"], window)).otherwise(told(s["ws"], s["vs"]))
    made = lambda t: F.transform(F.filter(lists(t), lambda s: (F.size(s["ws"]) > 1) | (s["ws"][0] != "")), hashed)
    return F.flatten(F.flatten(F.transform(F.array(template(text, names)), made)))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, item_id, coverage, n_slots, reparameterised: the benchmark items that documents hold."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null").distinct()
    # form 0 is the whole template, form 1 the one without names
    both = lambda make: make(True).withColumn("form", F.lit(0)).unionByName(make(False).withColumn("form", F.lit(1)))
    texts = items
    items = both(lambda names: texts.select("item_id", F.posexplode(_windows(F.col("text"), names, window)).alias("item_at", "hash")))
    items = written(items, "item-windows")
    n = items.count()
    of_item = items.select("form", "item_id", "hash").distinct()
    sizes = items.groupBy("form", "item_id").agg(F.countDistinct("hash").alias("item_windows"))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    # each form is joined on its own, by one number: a key of two columns is looked up at several times the cost
    def hit(names: bool) -> DataFrame:
        # the outer form keeps Spark from testing, thus making, the windows a second time below the explosion
        spread = source.select("doc_id", _windows(F.col("text"), names, window).alias("hashes")).select("doc_id", F.posexplode_outer("hashes").alias("doc_at", "hash"))
        return spread.join(sized(items.where(F.col("form") == int(not names)).select("hash").distinct(), n), "hash")

    # a row a window that any item has, however often items repeat it
    hits = written(both(hit).select("form", "doc_id", "hash", "doc_at"), "hits")
    met = hits.select("form", "doc_id", "hash").distinct().join(sized(of_item, n), ["form", "hash"])
    likely = met.groupBy("form", "doc_id", "item_id").agg(F.count("*").alias("n")).join(sized(sizes, n), ["form", "item_id"]).where(F.col("n") >= similarity * F.col("item_windows")).select("form", "doc_id", "item_id", "item_windows")
    likely = written(likely, "likely")
    m = likely.count()
    pair = ["form", "doc_id", "item_id"]
    near = hits.join(sized(likely, m), ["form", "doc_id"]).join(sized(items, n), ["form", "item_id", "hash"])
    near = written(near.withColumn("shift", F.col("doc_at") - F.col("item_at")), "near")
    # the placeholders of the documents and items in play; these are written, so that templates are made of their texts alone
    pick = lambda df, key: written(df.join(sized(likely.select(key).distinct(), m), key, "left_semi"), "texts")
    placed = lambda df, key, out: both(lambda names: df.select(key, F.explode(slots(F.col("text"), names)).alias("s")).select(key, F.col("s.word").alias(f"{out}_word"), "s.nth", F.col("s.value").alias(f"{out}_value")))
    item_slots, doc_slots = placed(pick(texts, "item_id"), "item_id", "item"), placed(pick(source, "doc_id"), "doc_id", "doc")
    covered = near.select(*pair, "shift", F.explode(F.sequence(F.col("item_at"), F.col("item_at") + (window - 1))).alias("item_word")).distinct()
    paired = covered.join(item_slots, ["form", "item_id", "item_word"]).withColumn("doc_word", F.col("item_word") + F.col("shift")).join(doc_slots, ["form", "doc_id", "doc_word", "nth"])
    values = written(paired.groupBy(*pair, "shift", "item_value").agg(F.countDistinct("doc_value").alias("values"), F.min("doc_value").alias("doc_value"), F.count("*").alias("slots"), F.max((F.col("doc_value") != F.col("item_value")).cast("int")).alias("other")), "slot-values")
    judged = values.groupBy(*pair, "shift").agg(F.max("values").alias("values"), F.sum("slots").alias("slots"), F.max("other").alias("other"))
    sound = written(near.join(judged, [*pair, "shift"], "left").where(F.coalesce("values", F.lit(1)) <= 1), "sound")
    # the alignment with the most windows says what each value stands for; those that contradict it don't count
    most = sound.groupBy(*pair, "shift").agg(F.countDistinct("hash").alias("n")).groupBy(*pair).agg(F.max_by("shift", F.struct("n", -F.col("shift"))).alias("shift"))
    said = values.join(most, [*pair, "shift"]).select(*pair, "item_value", F.col("doc_value").alias("said"))
    against = values.join(said, [*pair, "item_value"]).where("doc_value <> said").select(*pair, "shift").distinct()
    found = sound.join(against, [*pair, "shift"], "left_anti")
    out = found.groupBy(*pair, "item_windows").agg(F.countDistinct("hash").alias("n"), F.coalesce(F.max("slots"), F.lit(0)).alias("n_slots"), (F.coalesce(F.min(F.coalesce("other", F.lit(0))), F.lit(0)) > 0).alias("reparameterised"))
    held = out.where(F.col("n") >= similarity * F.col("item_windows")).groupBy("doc_id", "item_id").agg(F.min(F.struct("form", (F.col("n") / F.col("item_windows")).alias("coverage"), "n_slots", "reparameterised")).alias("o"))
    return held.select("doc_id", "item_id", "o.coverage", "o.n_slots", "o.reparameterised")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """docs without those that hold a benchmark item."""
    bad = written(contaminated(docs, benchmark, doc_id, **options).select(F.col("doc_id").alias(doc_id)).distinct(), "leaks")
    return docs.join(sized(bad, bad.count()), doc_id, "left_anti").select(docs.columns)
