"""Chat formatting with a grammar that is read back.

A conversation is its turns in order, one to a line:

    turn    = open " " body " " close
    open    = "[INST]" | "<s>" | "[SYS]" | "[ROLE=" name "]"          for user, assistant, system, any other role
    close   = "[/INST]" | "</s>" | "[/SYS]" | "[/ROLE]"
    escaped = the same with "*" after INST, s, SYS or ROLE in `open`: the body has &lt; &#91; &amp; for < [ &

A conversation is first rendered as it stands and parsed again. If the turns found are not the turns given, texts that hold one
of the escaped characters are escaped; then no body can hold a control string, and the second parse must agree (else an error).
All is built-in functions: no Python runs on the executors.

Defined results: null roles and texts are empty; turns are ordered by turn, role and text with nulls first; repeated rows are
repeated turns; rows with a null conv_id are one conversation; an empty table gives no rows; other columns are ignored. A
conversation is one value of the result, so its turns meet in one task; the work there is linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the template: role, open, open of an escaped body, close.
TAGS = (("user", "[INST]", "[INST*]", "[/INST]"), ("assistant", "<s>", "<s*>", "</s>"), ("system", "[SYS]", "[SYS*]", "[/SYS]"))
TURN = r"(?s)(\[INST\*?\]|<s\*?>|\[SYS\*?\]|\[ROLE\*?=[^\]]*\]) (.*?) (\[/INST\]|</s>|\[/SYS\]|\[/ROLE\])"
TURNS = "array<struct<role:string,text:string>>"


def escape(x: Column) -> Column:
    for raw, mark in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;")):
        x = F.replace(x, F.lit(raw), F.lit(mark))
    return x


def unescape(x: Column) -> Column:
    for raw, mark in (("]", "&#93;"), ("[", "&#91;"), ("<", "&lt;"), ("&", "&amp;")):
        x = F.replace(x, F.lit(mark), F.lit(raw))
    return x


def render(turns: Column, escaped: bool) -> Column:
    def turn(x: Column) -> Column:
        mark = x["text"].rlike(r"[&<\[\]]") if escaped else F.lit(False)
        open_, close = None, None
        for role, plain, starred, end in TAGS:
            at, tag = x["role"] == role, F.when(mark, F.lit(starred)).otherwise(F.lit(plain))
            open_ = F.when(at, tag) if open_ is None else open_.when(at, tag)
            close = F.when(at, F.lit(end)) if close is None else close.when(at, F.lit(end))
        open_ = open_.otherwise(F.concat(F.when(mark, F.lit("[ROLE*=")).otherwise(F.lit("[ROLE=")), escape(x["role"]), F.lit("]")))
        body = F.when(mark, escape(x["text"])).otherwise(x["text"])
        return F.concat(open_, F.lit(" "), body, F.lit(" "), close.otherwise(F.lit("[/ROLE]")))

    return F.array_join(F.transform(turns, turn), "\n")


def is_escaped(open_: Column) -> Column:
    return open_.rlike(r"^(\[INST\*|<s\*|\[SYS\*|\[ROLE\*)")


def role_of(open_: Column) -> Column:
    found = None
    for role, plain, starred, _ in TAGS:
        at = open_.isin(plain, starred)
        found = F.when(at, F.lit(role)) if found is None else found.when(at, F.lit(role))
    return found.otherwise(unescape(F.regexp_extract(open_, r"^\[ROLE\*?=([^\]]*)\]$", 1)))


def parse(formatted: Column) -> Column:
    """array<struct<role,text>>: the turns a reader finds."""
    opens, bodies = (F.regexp_extract_all(formatted, F.lit(TURN), F.lit(g)) for g in (1, 2))
    return F.zip_with(opens, bodies, lambda o, b: F.struct(role_of(o).alias("role"), F.when(is_escaped(o), unescape(b)).otherwise(b).alias("text"))).cast(TURNS)


def loss_mask(formatted: Column) -> Column:
    """array<struct<skip,take,rest,escaped,body>>, one for each turn: code points of the formatted text that are not under the loss,
    then those that are (an assistant's body), then the others up to the next turn. All of them in a row are the whole text (and one
    line end that the last turn lacks). `body`: what is taken, as it stands in the text."""
    whole, opens, bodies = (F.regexp_extract_all(formatted, F.lit(TURN), F.lit(g)) for g in (0, 1, 2))

    def turn(o: Column, x: Column) -> Column:
        taken = F.when(o.isin("<s>", "<s*>"), x["body"]).otherwise(F.lit(""))
        skip = F.length(o) + 1
        rest = F.length(x["whole"]) + 1 - skip - F.length(taken)
        return F.struct(skip.alias("skip"), F.length(taken).alias("take"), rest.alias("rest"), is_escaped(o).alias("escaped"), taken.alias("body"))

    return F.zip_with(opens, F.zip_with(bodies, whole, lambda b, w: F.struct(b.alias("body"), w.alias("whole"))), turn)


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns, formatted, loss_mask): turns as read back from `formatted`."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    given = rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(turn)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).cast(TURNS).alias("given"))
    plain = given.withColumn("plain", render(F.col("given"), False))
    chosen = plain.withColumn("formatted", F.when(parse(F.col("plain")) == F.col("given"), F.col("plain")).otherwise(render(F.col("given"), True)))
    read = chosen.withColumn("turns", parse(F.col("formatted")))
    same = F.when(F.col("turns") == F.col("given"), F.col("turns")).otherwise(F.raise_error(F.concat(F.lit("not read back: conversation "), F.col("conv_id").cast("string"))))
    return read.select("conv_id", same.cast(TURNS).alias("turns"), "formatted", loss_mask(F.col("formatted")).alias("loss_mask"))


def digest_columns(made: DataFrame) -> DataFrame:
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")

    loss = F.transform("loss_mask", lambda x: F.when(x["escaped"], unescape(x["body"])).otherwise(x["body"]))
    out = made.withColumn("_loss", F.array_join(loss, ""))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_chat_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    return digest_columns(format_conversations(rows.unionByName(own)))


#: A conversation whose plain form is read back differently has each of & < [ ] in its texts as 4 or 5 characters.
OP8_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    bool_or(regexp_matches(text, ' (\\[/INST\\]|</s>|\\[/SYS\\]|\\[/ROLE\\])')) AS conflict,
    sum(length(text) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 13
      ELSE 17 + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;')) END) + count(*) - 1 AS plain,
    sum(4 * (length(text) - length(replace(replace(replace(text, '&', ''), '[', ''), ']', '')))
      + 3 * (length(text) - length(replace(text, '<', '')))
      + CASE WHEN regexp_matches(text, '[&<\\[\\]]') THEN 1 ELSE 0 END) AS more
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(plain + CASE WHEN conflict THEN more ELSE 0 END AS BIGINT) AS formatted_chars
FROM g
"""
