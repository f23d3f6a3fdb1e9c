"""Chat formatting: heterogeneous records to one turn template, by schema fingerprints.

A record is a JSON object.  Of its nested field paths, those of the most
specific mapping below that has all it names are hashed to a fingerprint, which
selects that mapping; it turns the record into canonical (role, text) turns.
Other fields do not change the fingerprint.  All steps are DataFrame
expressions.

Template: every turn is ``<|role|>\\n`` text ``<|end|>\\n``.  Inside roles and
texts a backslash is put into each control string, one more into each that
already holds some, so that reading back is exact.  The output comes in
segments with a loss flag; only assistant texts are under the loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nested field paths that mappings know, in order of the fingerprint.
PATHS = ["role", "text", "content", "messages", "messages[0].role", "messages[0].content", "conversations", "conversations[0].from", "conversations[0].value", "system", "instruction", "input", "output", "prompt", "completion", "response", "question", "answer"]

_ROLE = "CASE {0} WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE {0} END"


def _one(role: str, path: str) -> str:
    return f"struct('{role}' AS role, try_variant_get(v, '$.{path}', 'string') AS text)"


def _opt(role: str, path: str) -> str:
    return f"CASE WHEN try_variant_get(v, '$.{path}', 'string') <> '' THEN {_one(role, path)} END"


def _list(path: str, role: str, text: str) -> str:
    items = f"try_variant_get(v, '$.{path}', 'array<struct<{role}: string, {text}: string>>')"
    return f"transform({items}, m -> struct({_ROLE.format('m.`' + role + '`')} AS role, m.`{text}` AS text))"


def _listed(*turns: str) -> str:
    return f"filter(array({', '.join(turns)}), t -> t IS NOT NULL)"


_ASK = "struct('user' AS role, concat_ws('\\n\\n', try_variant_get(v, '$.instruction', 'string'), nullif(try_variant_get(v, '$.input', 'string'), '')) AS text)"

#: Field paths of a layout -> its canonical turns, an expression over the record ``v``.
MAPPINGS: dict[tuple[str, ...], str] = {
    ("role", "text"): "array(struct(try_variant_get(v, '$.role', 'string') AS role, try_variant_get(v, '$.text', 'string') AS text))",
    ("role", "content"): "array(struct(try_variant_get(v, '$.role', 'string') AS role, try_variant_get(v, '$.content', 'string') AS text))",
    ("messages", "messages[0].role", "messages[0].content"): _list("messages", "role", "content"),
    ("messages", "messages[0].role", "messages[0].content", "system"): f"concat(array({_one('system', 'system')}), {_list('messages', 'role', 'content')})",
    ("conversations", "conversations[0].from", "conversations[0].value"): _list("conversations", "from", "value"),
    ("conversations", "conversations[0].from", "conversations[0].value", "system"): f"concat(array({_one('system', 'system')}), {_list('conversations', 'from', 'value')})",
    ("messages",): "CAST(array() AS array<struct<role: string, text: string>>)",
    ("conversations",): "CAST(array() AS array<struct<role: string, text: string>>)",
    ("instruction", "output"): _listed(_ASK, _one("assistant", "output")),
    ("instruction", "input", "output"): _listed(_ASK, _one("assistant", "output")),
    ("system", "instruction", "output"): _listed(_opt("system", "system"), _ASK, _one("assistant", "output")),
    ("system", "instruction", "input", "output"): _listed(_opt("system", "system"), _ASK, _one("assistant", "output")),
    ("prompt", "completion"): _listed(_one("user", "prompt"), _one("assistant", "completion")),
    ("prompt", "response"): _listed(_one("user", "prompt"), _one("assistant", "response")),
    ("system", "prompt", "completion"): _listed(_opt("system", "system"), _one("user", "prompt"), _one("assistant", "completion")),
    ("system", "prompt", "response"): _listed(_opt("system", "system"), _one("user", "prompt"), _one("assistant", "response")),
    ("system", "question", "answer"): _listed(_opt("system", "system"), _one("user", "question"), _one("assistant", "answer")),
    ("question", "answer"): _listed(_one("user", "question"), _one("assistant", "answer")),
}

#: What must not be read as template marks: this template's and other common ones'.
_CONTROL = r"(\||/?s>|/?INST\]|<?/?SYS>>)"
CHUNK = 64

#: Characters of a JSON string beyond which Spark's parser gives up unless told otherwise.
LONGEST = 20_000_000
_ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}


def escaped(x: Column) -> Column:
    return F.regexp_replace(x, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescaped(x: Column) -> Column:
    return F.regexp_replace(x, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def _escaped_role(x: Column) -> Column:
    return F.regexp_replace(escaped(x), r"\|(\\*)>", r"|\\$1>")


def _unescaped_role(x: Column) -> Column:
    return unescaped(F.regexp_replace(x, r"\|\\(\\*)>", "|$1>"))


def _key(paths: tuple[str, ...]) -> Column:
    return F.xxhash64(F.lit(",".join(p for p in PATHS if p in paths)))


def _parsed(record: Column) -> Column:
    """``record`` as a variant, null if it is no JSON; what is JSON but does not fit a variant stops the query."""
    whole = F.from_json(record, "variant", _ANY_LENGTH)
    keys = F.size(F.from_json(record, "map<string,string>", _ANY_LENGTH))
    large = F.when(whole.isNull() & (keys > 0), F.raise_error(F.lit("a chat record is larger than a variant can be"))).otherwise(whole)
    return F.coalesce(F.try_parse_json(record), F.when(F.char_length(record) > LONGEST, large))


def canonical_turns(records: DataFrame, record_col: str = "record") -> DataFrame:
    """``records`` with ``fingerprint long``, ``layout string`` and ``turns array<struct<role, text>>``.

    Of the mappings whose fields a record has, the one that names most counts,
    the first of equals.  A record that is null, no JSON object, or without any
    such mapping gets a null layout and no turns.  Texts may have any length; a
    record of more than 128 MiB, the most that a variant holds, is an error.
    An empty table stays empty.  Columns of the three names are replaced, all
    others stay.
    """
    fresh = ("fingerprint", "layout", "turns")
    read = records.select(F.struct(*(F.col(f"`{c}`") for c in records.columns)).alias("row"), _parsed(F.col(f"`{record_col}`")).alias("v"))
    has = F.struct(*(F.expr(f"try_variant_get(v, '$.{p}', 'variant') IS NOT NULL").alias(f"p{k}") for k, p in enumerate(PATHS)))
    read = read.withColumn("has", has)
    fits = lambda paths: F.expr(" AND ".join(f"has.p{PATHS.index(p)}" for p in paths))
    chosen = F.coalesce(*(F.when(fits(paths), _key(paths)) for paths in sorted(MAPPINGS, key=lambda m: -len(m))))
    every = F.xxhash64(F.concat_ws(",", F.array_compact(F.array(*(F.when(F.col(f"has.p{k}"), F.lit(p)) for k, p in enumerate(PATHS))))))
    read = read.withColumn("fingerprint", F.coalesce(chosen, every))
    layout = turns = None
    for paths, expr in MAPPINGS.items():
        hit = F.col("fingerprint") == _key(paths)
        layout = F.when(hit, F.lit("+".join(paths))) if layout is None else layout.when(hit, F.lit("+".join(paths)))
        value = F.expr(f"CAST({expr} AS array<struct<role: string, text: string>>)")
        turns = F.when(hit, value) if turns is None else turns.when(hit, value)
    none = F.expr("CAST(array() AS array<struct<role: string, text: string>>)")
    own = [F.col(f"row.`{c}`").alias(c) for c in records.columns if c not in fresh]
    return read.select(*own, "fingerprint", layout.alias("layout"), F.coalesce(turns, none).alias("turns"))


def format_chats(turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn") -> DataFrame:
    """``(conv_id, segments array<struct<text, loss>>, unread, formatted)`` from rows with ``turns``.

    ``unread`` counts the rows whose ``layout`` is null, that is, which gave no
    turns because no mapping knows them.

    Rows of one id are joined in order of ``order_col`` (null first), ties by
    their turns' role and text; rows that repeat stay.  Null roles and texts
    are empty.  Rows are gathered in runs of ``CHUNK`` orders first, so that a
    long conversation meets in one task only as its finished runs; a
    conversation's formatted text is one value and must fit a row.
    """
    part = F.struct(F.col(order_col).alias("o"), F.transform("turns", lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))).alias("turns"))
    unread = F.col("layout").isNull().cast("long") if "layout" in turns.columns else F.lit(0)
    chunk = F.coalesce(F.floor(F.col(order_col) / CHUNK), F.lit(-(2**62)))
    runs = turns.groupBy(F.col(id_col).alias("conv_id"), chunk.alias("chunk")).agg(F.array_sort(F.collect_list(part), lambda a, b: _compare(a, b)).alias("rows"), F.sum(unread).alias("unread"))
    runs = runs.select("conv_id", "chunk", "unread", F.flatten(F.transform("rows", lambda r: r["turns"])).alias("turns"))
    whole = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "turns"))).alias("chunks"), F.sum("unread").alias("unread"))
    whole = whole.select("conv_id", "unread", F.flatten(F.transform("chunks", lambda c: c["turns"])).alias("turns"))

    def pieces(t: Column) -> Column:
        seg = lambda text, loss: F.named_struct(F.lit("text"), text, F.lit("loss"), loss)
        return F.array(
            seg(F.concat(F.lit("<|"), _escaped_role(t["role"]), F.lit("|>\n")), F.lit(False)),
            seg(escaped(t["text"]), t["role"] == "assistant"),
            seg(F.lit("<|end|>\n"), F.lit(False)),
        )

    out = whole.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"), "unread")
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def _compare(a: Column, b: Column) -> Column:
    def by(x: Column, y: Column, then: Column) -> Column:
        return F.when(x.isNull() & y.isNull(), then).when(x.isNull() | (x < y), F.lit(-1)).when(y.isNull() | (x > y), F.lit(1)).otherwise(then)

    text = lambda r: F.array_join(F.transform(r["turns"], lambda t: F.concat(t["role"], F.lit("\n"), t["text"])), "\n")
    return by(a["o"], b["o"], by(text(a), text(b), F.lit(0)))


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, turns, loss_texts, formatted)`` parsed from the output of ``format_chats``."""

    def turn(piece: Column) -> Column:
        at = F.instr(piece, "|>\n")
        role = F.substring(piece, F.lit(3), at - 3)
        return F.named_struct(F.lit("role"), _unescaped_role(role), F.lit("text"), unescaped(F.substring(piece, at + 3, F.length(piece))))

    pieces = F.split("formatted", r"<\|end\|>\n", -1)
    return formatted.select("conv_id", F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn).alias("turns"), F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])).alias("loss_texts"), "formatted")
