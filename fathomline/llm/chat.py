"""Chat formatting with relational operators and Spark expressions only.

Turns are gathered per conversation, sorted as structs, merged into blocks of adjacent equal
roles by an array aggregation, and written as text:

    <s>role NL text [NL <sep> NL text ...] NL </s>

Inside roles and texts every control string, with any backslashes before it, gets one backslash
more; a real mark follows a line break and never a backslash, so the text reads back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's own marks, then strings of other chat templates that must not act inside a text.
OPEN, CLOSE, JOIN = "<s>", "</s>", "<sep>"
CONTROL = r"(?:</?s>|<sep>|\[/?INST\]|<</?SYS>>|<\|[A-Za-z_]{1,32}\|>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*{CONTROL})", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*{CONTROL})", "$1")


def _role(role: Column) -> Column:
    """A role on one line: percent signs and line breaks are written as %25 and %0A."""
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _read_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def formatted(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, text, loss_spans (start and length in characters).

    Rows are ordered by (turn, role, text), null turns first, so ties and repeated rows have one
    result and every row is kept. Null texts and roles count as empty. A null conv_id is a
    conversation of its own. The spans cover each text of ``loss_role`` as it stands in the
    output, escapes included. Other columns are ignored; an empty table gives no rows.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("turn"),
    )
    kept = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    none = F.expr("CAST(array() AS array<struct<role: string, texts: array<string>>>)")
    merged = F.aggregate(
        "turns",
        none,
        lambda done, t: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["role"] == t["role"]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(
                    t["role"].alias("role"),
                    F.concat(F.try_element_at(done, F.lit(-1))["texts"], F.array(escaped(t["text"]))).alias("texts"),
                )),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(t["role"].alias("role"), F.array(escaped(t["text"])).alias("texts"))))),
    )
    blocks = kept.select("conv_id", merged.alias("blocks"))
    head = lambda b: F.concat(F.lit(OPEN), escaped(_role(b["role"])), F.lit("\n"))
    body = lambda b: F.array_join(b["texts"], f"\n{JOIN}\n")
    written = blocks.select(
        "conv_id", "blocks",
        F.transform("blocks", lambda b: F.concat(head(b), body(b), F.lit(f"\n{CLOSE}"))).alias("parts"),
    )
    spans = F.aggregate(
        F.arrays_zip("blocks", "parts"),
        F.expr("named_struct('at', 0L, 'spans', CAST(array() AS array<struct<start: bigint, length: bigint>>))"),
        lambda done, z: F.struct(
            (done["at"] + F.length(z["parts"])).alias("at"),
            F.when(
                z["blocks"]["role"] == loss_role,
                F.concat(done["spans"], F.aggregate(
                    z["blocks"]["texts"],
                    F.struct(
                        (done["at"] + F.length(head(z["blocks"]))).alias("at"),
                        F.expr("CAST(array() AS array<struct<start: bigint, length: bigint>>)").alias("spans"),
                    ),
                    lambda inner, x: F.struct(
                        (inner["at"] + F.length(x) + len(f"\n{JOIN}\n")).alias("at"),
                        F.concat(inner["spans"], F.array(F.struct(
                            inner["at"].alias("start"), F.length(x).cast("long").alias("length")))).alias("spans"),
                    ),
                )["spans"]),
            ).otherwise(done["spans"]).alias("spans"),
        ),
    )["spans"]
    return written.select("conv_id", F.array_join("parts", "").alias("text"), spans.alias("loss_spans"))


def parsed(text: Column) -> Column:
    """The rows of a formatted conversation as an array of (role, text), read from its text."""
    blocks = F.filter(F.split(text, f"\\n{CLOSE}"), lambda b: b != "")
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(F.substr(b, F.locate("\n", b) + 1), f"\\n{JOIN}\\n"),
        lambda x: F.struct(
            _read_role(unescaped(F.substr(F.substring_index(b, "\n", 1), F.lit(len(OPEN) + 1)))).alias("role"),
            unescaped(x).alias("text"),
        ),
    )))


def loss_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(
        F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def op6_chat(spark, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.sql(
        "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    out = formatted(given.unionByName(own))
    back = out.select("conv_id", "text", parsed(F.col("text")).alias("turns"), loss_text(F.col("text"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )


_ESC = "regexp_replace({}, '(\\\\*(?:</?s>|<sep>|\\[/?INST\\]|<</?SYS>>|<\\|[A-Za-z_]{{1,32}}\\|>))', '\\\\\\1', 'g')"
OP6_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, row_number() OVER w AS k, coalesce(lag(role) OVER w = role, false) AS joins
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_ESC.format('text')}) + CASE WHEN joins THEN 7 ELSE 9 + length({_ESC.format("replace(replace(role, '%', '%25'), chr(10), '%0A')")}) END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
