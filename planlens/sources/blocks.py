"""Large JSON files in blocks: one file is read by many tasks.

A file is read in pieces that end at ``}``, which Spark's text source can split at
any block. What a piece does to a reader is a small function: whether it flips being
inside a string, and by how much it changes the depth if it begins outside or inside
of one. Functions of pieces compose within a block, those of blocks within a file,
both as running sums; so every piece knows the state in which it begins, and records
are cut where an object closes at the depth at which the file holds its records.

The text is shuffled by block only; records that lie across two blocks are the only
ones that meet by file. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import keep

_KEY = ("file", "start")


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _bare(text: Column) -> Column:
    """A text without its strings, escapes being gone; an open string goes to the end."""
    return F.regexp_replace(text, '"[^"]*+(?:"|$)', "")


def _before(partition: tuple[str, ...], *order: str) -> Window:
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _running(c: Column, w: Window) -> Column:
    return F.coalesce(F.sum(c).over(w), F.lit(0))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, i, text, q, d0, d1)``: pieces in order ``(start, i)`` of each
    file; ``q`` is 1 if a piece begins inside a string, ``d0`` and ``d1`` are the
    depths before and after it. A file's last piece may lack its ``}``."""
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i"), F.concat("value", F.lit("}")).alias("text")
    )
    plain = F.regexp_replace("text", r"\\.", "")  # no JSON escape ends in a brace, so none lies across pieces
    marked = raw.withColumn("plain", plain)
    depth = lambda t: _count(t, "{[") - _count(t, "}]")
    marked = marked.select(*_KEY, "i", "text", (_count(F.col("plain"), '"') % 2).alias("odd"), depth(_bare(F.col("plain"))).alias("out"), depth(_bare(F.concat(F.lit('"'), "plain"))).alias("in"))
    own = _before(_KEY, "i")
    local = marked.withColumn("lq", _running(F.col("odd"), own) % 2)
    # depths in the block, if it begins outside or inside of a string
    local = local.withColumn("e0", F.when(F.col("lq") == 0, F.col("out")).otherwise(F.col("in"))).withColumn("e1", F.when(F.col("lq") == 0, F.col("in")).otherwise(F.col("out")))
    local = local.withColumn("b0", _running(F.col("e0"), own)).withColumn("b1", _running(F.col("e1"), own))
    blocks = local.groupBy(*_KEY).agg((F.sum("odd") % 2).alias("odd"), F.sum("e0").alias("e0"), F.sum("e1").alias("e1"))
    all_before = _before(("file",), "start")
    blocks = blocks.withColumn("bq", _running(F.col("odd"), all_before) % 2)
    blocks = blocks.withColumn("bd", _running(F.when(F.col("bq") == 0, F.col("e0")).otherwise(F.col("e1")), all_before)).select(*_KEY, "bq", "bd")
    every = local.join(blocks, list(_KEY))
    d0 = F.col("bd") + F.when(F.col("bq") == 0, F.col("b0")).otherwise(F.col("b1"))
    d1 = d0 + F.when(F.col("bq") == 0, F.col("e0")).otherwise(F.col("e1"))
    return every.select(*_KEY, "i", "text", ((F.col("lq") + F.col("bq")) % 2).alias("q"), ((F.col("lq") + F.col("bq") + F.col("odd")) % 2).alias("q1"), d0.alias("d0"), d1.alias("d1"))


#: Strings, brackets, colons and what is between them; an object that holds no other.
_TOKENS = r'"(?:[^"\\]|\\.)*+"?|[\[\]{}:]|[^"\[\]{}:]+'
_FLAT = r'\{(?:"(?:[^"\\]|\\.)*+"|[^"\[\]{}])*+\}'


def _outlined(text: Column, q: Column, depth: Column, inside: Column, key: str) -> Column:
    """``(own, rest, last, keys)`` of a piece of an object: what is within the list that
    is ``key``'s value, all other text, whether the piece ends inside that list, and
    the root keys that are named here. A fold over strings, brackets and what is between."""
    head = F.when(q == 1, F.regexp_extract(text, r'^(?:[^"\\]|\\.)*+"?', 0)).otherwise("")
    body = F.substr(text, F.length(head) + 1)
    cut = lambda pattern: F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    # below depth 1 nothing is named or entered, so that an object without brackets in it is one token there
    tokens = F.when((depth >= 1) & ~F.contains(text, F.lit("]")), cut(rf"{_FLAT}|{_TOKENS}")).otherwise(cut(_TOKENS))
    start = F.struct(depth.alias("d"), F.lit("").alias("s"), F.when(inside, head).otherwise("").alias("own"), F.when(inside, "").otherwise(head).alias("rest"), inside.alias("in"), F.lit(None).cast("boolean").alias("last"), F.array().cast("array<string>").alias("keys"))

    def step(s: Column, t: Column) -> Column:
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        d = s["d"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        named = (t == ":") & (s["d"] == 1) & s["s"].startswith('"')
        is_key = s["s"] == f'"{key}"'
        last = F.when(named, is_key).otherwise(s["last"])
        enters = (t == "[") & (s["d"] == 1) & F.coalesce(s["last"], F.lit(False))
        leaves = closes & (d == 1) & s["in"]
        inside_now = F.when(enters, True).when(leaves, False).otherwise(s["in"])
        takes = s["in"] & ~leaves
        string = F.when(t.startswith('"'), t).when(F.trim(t) == "", s["s"]).otherwise("")
        return F.struct(d.alias("d"), string.alias("s"), F.when(takes, F.concat(s["own"], t)).otherwise(s["own"]).alias("own"), F.when(takes, s["rest"]).otherwise(F.concat(s["rest"], t)).alias("rest"), inside_now.alias("in"), last.alias("last"), F.when(named, F.array_append(s["keys"], s["s"])).otherwise(s["keys"]).alias("keys"))

    done = F.aggregate(tokens, start, step)
    return F.struct(done["own"].alias("own"), done["rest"].alias("rest"), done["in"].alias("last"), done["keys"].alias("keys"))


def documents(spark: SparkSession, path: str, fields: list[str], key: str = "data") -> tuple[DataFrame, DataFrame]:
    """``(file, ord, form, text)``: the records of JSON files, and ``(file, text)``: of
    files with a root key ``key``, the rest of the object with an empty list.

    ``form`` is ``list`` (a bare list), ``data`` (the list under ``key``), ``lines``
    (several objects, one a line or not), ``one`` (an object with one of ``fields``
    among its keys) or ``items`` (another object: its values, each text beginning with
    its key). Elements that are no objects are left out, as are empty files; text that
    is no JSON gives records that do not parse. A key that is not a plain string
    without escapes is no root key ``key``.
    """
    every = keep(pieces(spark, path), "pieces")
    place = F.struct("start", "i")
    ends = (F.col("d1") == 0) & (F.col("q1") == 0)
    bare_text = F.ltrim(F.regexp_replace("text", "^\ufeff", ""))
    files = every.groupBy("file").agg(F.min_by(F.substr(bare_text, F.lit(1), F.lit(1)), place).alias("root"), F.max_by("d1", place).alias("end"), F.max(place).alias("last"), F.sum(ends.cast("int")).alias("docs"))
    files = keep(files.withColumn("single", (F.col("root") == "{") & (F.col("docs") <= 1)), "files")
    # only a file's last piece may lack its brace, and then its depth ends too low
    torn = (F.col("end") == -1) & (place == F.col("last"))
    every = every.join(files, "file").withColumn("text", F.when(torn, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))).withColumn("closed", ~torn & (F.col("q1") == 0))
    many = F.when(F.col("root") == "[", "list").otherwise("lines")
    level = F.when(F.col("root") == "[", 1).otherwise(0)
    local = every.where(~F.col("single")).select(*_KEY, "i", many.alias("form"), "text", F.lit("").alias("rest"), (F.col("closed") & (F.col("d1") == level)).alias("cut"))
    if not files.where("single").isEmpty():
        local = local.union(_of_objects(every.where("single"), fields, key))
    return _records(local)


def _of_objects(every: DataFrame, fields: list[str], key: str) -> DataFrame:
    """Pieces of files of one object, with their form and where records end. Which root
    key a piece is under is again a function of the state in which it begins, here in
    or out of ``key``'s list; only pieces that touch depth 1 are looked into."""
    plain = F.regexp_replace("text", r"\\.", "")
    bare = _bare(F.when(F.col("q") == 1, F.concat(F.lit('"'), plain)).otherwise(plain))
    rises = F.contains(F.regexp_replace(bare, r"\[[^\[\]{}]*+\]", ""), F.lit("]"))
    touches = (F.col("d0") <= 1) | rises
    # the list lies below depth 1: a piece that begins above it begins outside
    either = {c: F.when(touches & some, _outlined(F.col("text"), F.col("q"), F.col("d0"), F.lit(state), key)) for c, state, some in (("from_out", False, F.lit(True)), ("from_in", True, F.col("d0") > 1))}
    every = every.withColumns(either).withColumn("set", F.when((F.col("from_out.last") == F.col("from_in.last")) | (touches & (F.col("d0") <= 1)), F.col("from_out.last")))  # null: it stays as it was
    every = keep(every.select(*_KEY, "i", "text", "d1", "closed", "from_out", "from_in", "set"), "objects")
    own, all_before = _before(_KEY, "i"), _before(("file",), "start")
    marks = every.groupBy(*_KEY).agg(F.max_by("set", F.when(F.col("set").isNotNull(), F.col("i"))).alias("set"))
    marks = marks.select(*_KEY, F.coalesce(F.last("set", True).over(all_before), F.lit(False)).alias("entered"))
    known = every.groupBy("file").agg(F.max(F.array_contains("from_out.keys", f'"{key}"')).alias("has"), F.max(F.arrays_overlap("from_out.keys", F.lit([f'"{f}"' for f in fields] or [""]))).alias("flat"))
    form = F.when(F.col("has"), "data").when(F.col("flat"), "one").otherwise("items")
    local = every.withColumn("here", F.last("set", True).over(own)).join(marks, list(_KEY)).join(known.select("file", form.alias("form")), "file").withColumn("inside", F.coalesce("here", "entered"))
    part = lambda c: F.when(F.col("inside"), F.coalesce(F.col(f"from_in.{c}"), F.col("text") if c == "own" else F.lit(""))).otherwise(F.coalesce(F.col(f"from_out.{c}"), F.lit("") if c == "own" else F.col("text")))
    in_list = F.coalesce(F.when(F.col("inside"), F.col("from_in.last")).otherwise(F.col("from_out.last")), F.col("inside"))
    level = F.when(F.col("form") == "data", 2).when(F.col("form") == "items", 1).otherwise(0)
    cut = F.col("closed") & (F.col("d1") == level) & ((F.col("form") != "data") | in_list)
    return local.select(*_KEY, "i", "form", F.when(F.col("form") == "data", part("own")).otherwise(F.col("text")).alias("text"), part("rest").alias("rest"), cut.alias("cut"))


def _records(local: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records from pieces with their ends: within blocks, and across them."""
    own, all_before = _before(_KEY, "i"), _before(("file",), "start")
    local = keep(local.withColumn("r", _running(F.col("cut").cast("int"), own)), "cut")
    joined = lambda c, *by: F.array_join(F.sort_array(F.collect_list(F.struct(*by, c)))[c], "")
    groups = local.groupBy(*_KEY, "form", "r").agg(joined("text", "i").alias("text"), F.max("cut").alias("cut"))
    cuts = local.groupBy(*_KEY).agg(F.sum(F.col("cut").cast("int")).alias("n")).select(*_KEY, _running(F.col("n"), all_before).alias("above"))
    groups = groups.join(cuts, list(_KEY)).withColumn("ord", F.col("r") + F.col("above"))
    across = groups.where("not (r > 0 and cut)").groupBy("file", "ord", "form").agg(joined("text", "start").alias("text"), F.max("cut").alias("cut"))
    records = groups.where("r > 0 and cut").select("file", "ord", "form", "text").union(across.where("cut").select("file", "ord", "form", "text"))
    rest = local.where("form = 'data' and rest <> ''").groupBy("file").agg(joined("rest", "start", "i").alias("text"))
    return records, rest
