"""Chat formatting by schema fingerprints (operator 2), in built-in functions only.

A payload struct that unites many layouts (as ``spark.read.json`` makes it: what a
row lacks is null) is fingerprinted row by row: the sorted nested paths that hold
something are hashed, and the hash selects a declarative mapping to canonical
turns.  Turns are rendered with control strings around them; control strings inside
texts are escaped so that :func:`read_back` restores every text exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Control strings of the template: around turns with and without loss.
OPEN, CLOSE, LOSS_OPEN, LOSS_CLOSE = "[INST]", "[/INST]", "<s>", "</s>"
CONTROL_HEAD = r"([<\[])(?=/?(?:s>|INST\]))"
LOSS_ROLE = "assistant"

TURNS = "array<struct<role:string,text:string>>"


def _turn(role: Column | str, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _two(question: str, answer: str, joined: str = "", system: str = "") -> Callable[[Callable[[str], Column]], Column]:
    """A mapping of flat fields to a user and an assistant turn."""

    def build(field: Callable[[str], Column]) -> Column:
        ask = F.coalesce(field(question), F.lit(""))
        if joined:
            ask = F.concat(ask, F.when(F.length(field(joined)) > 0, F.concat(F.lit("\n\n"), field(joined))).otherwise(F.lit("")))
        both = F.array(_turn("user", ask), _turn(LOSS_ROLE, field(answer)))
        return F.when(field(system).isNotNull(), F.concat(F.array(_turn("system", field(system))), both)).otherwise(both) if system else both

    return build


def _listed(items: str, role: str, text: str, names: dict[str, str] | None = None) -> Callable[[Callable[[str], Column]], Column]:
    """A mapping of a list of messages; ``names`` gives canonical role names."""

    def build(field: Callable[[str], Column]) -> Column:
        def one(m: Column) -> Column:
            r = m[role]
            for k, v in (names or {}).items():
                r = F.when(m[role] == k, v).otherwise(r)
            return _turn(r, m[text])

        return F.transform(field(items), one)

    return build


@dataclass(frozen=True)
class Mapping:
    """``main`` paths, all in the schema and at least one in the row, and any of ``optional`` ones lead to ``turns``.

    ``x[].y`` is a field of the structs in a list.
    """

    name: str
    main: tuple[str, ...]
    optional: tuple[str, ...]
    turns: Callable[[Callable[[str], Column]], Column]

    def fingerprints(self) -> list[str]:
        def some(paths: tuple[str, ...], least: int) -> list[tuple[str, ...]]:
            return [x for n in range(least, len(paths) + 1) for x in combinations(paths, n)]

        return [fingerprint_of({*a, *b}) for a in some(self.main, 1) for b in some(self.optional, 0)]


def fingerprint_of(paths: set[str]) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), (), _listed("messages", "role", "content")),
    Mapping("share", ("conversations[].from", "conversations[].value"), (), _listed("conversations", "from", "value", {"human": "user", "gpt": LOSS_ROLE})),
    Mapping("prompt_response", ("prompt", "response"), ("system",), _two("prompt", "response", system="system")),
    Mapping("prompt_completion", ("prompt", "completion"), ("system",), _two("prompt", "completion", system="system")),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), _two("instruction", "output", "input", "system")),
    Mapping("question_answer", ("question", "answer"), ("system",), _two("question", "answer", system="system")),
)


def _present(value: Column, kind: T.DataType, path: str) -> list[tuple[str, Column]]:
    """The leaf paths below a value, each with whether a row has something there."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _present(value[f.name], f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, T.StructType | T.ArrayType):
            names = [p for p, _ in _present(value[0], inner, f"{path}[]")]
            return [(p, F.coalesce(F.exists(value, _nth_present(inner, i)), F.lit(False))) for i, p in enumerate(names)]
        return [(f"{path}[]", F.coalesce(F.exists(value, lambda x: x.isNotNull()), F.lit(False)))]
    return [(path, value.isNotNull())]


def _nth_present(kind: T.DataType, i: int) -> Callable[[Column], Column]:
    return lambda x: _present(x, kind, "")[i][1]


def fingerprint(payload: str, kind: T.StructType, known: set[str]) -> Column:
    """Hash of the nested paths that a row's payload holds, of those any mapping knows."""
    found = sorted((p, c) for p, c in _present(F.col(payload), kind, "") if p in known)
    return F.md5(F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(p)) for p, c in found] or [F.lit(None).cast("string")])), "\n"))


def canonical_turns(rows: DataFrame, payload: str = "payload", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Add ``layout`` (the chosen mapping's name or null) and ``turns``.

    A payload whose paths fit no mapping, or that is null, keeps its row with null
    ``layout`` and ``turns``.  Paths that no mapping speaks of are ignored.  A null
    text is empty, a prompt or an answer too; a null role is empty.  A row that fits several
    mappings, as one with a prompt alone may, goes to the first.
    """
    kind = rows.schema[payload].dataType
    known = {p for m in mappings for p in (*m.main, *m.optional)}
    have = {p for p, _ in _present(F.col(payload), kind, "")}
    usable = [m for m in mappings if {*m.main} <= have]
    named = rows.withColumn("layout", F.lit(None).cast("string"))
    if usable:
        of = {f: m.name for m in reversed(usable) for f in m.fingerprints()}  # what fits several goes to the first
        table = F.create_map(*[F.lit(x) for kv in of.items() for x in kv])
        named = rows.withColumn("layout", F.element_at(table, fingerprint(payload, kind, known)))
    turns = F.lit(None).cast(TURNS)
    top = set(kind.fieldNames())

    def field(name: str) -> Column:
        return F.col(payload)[name] if name in top else F.lit(None).cast("string")

    for m in usable:
        turns = F.when(F.col("layout") == m.name, m.turns(field).cast(TURNS)).otherwise(turns)
    return named.withColumn("turns", turns)


def escaped(text: Column) -> Column:
    """``text`` without any control string; backslashes are doubled and one is put into each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL_HEAD, "$1\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: Column, loss_role: str = LOSS_ROLE) -> Column:
    """One string of all turns: ``<s>role\\ntext</s>`` where the loss counts, ``[INST]role\\ntext[/INST]`` elsewhere.

    Roles are percent-encoded, so they hold neither line breaks nor control strings.
    """

    def one(t: Column) -> Column:
        body = F.concat(F.url_encode(t["role"]), F.lit("\n"), escaped(t["text"]))
        return F.when(t["role"] == loss_role, F.concat(F.lit(LOSS_OPEN), body, F.lit(LOSS_CLOSE))).otherwise(F.concat(F.lit(OPEN), body, F.lit(CLOSE)))

    return F.array_join(F.transform(turns, one), "")


def read_back(text: Column) -> Column:
    """The turns of a formatted string as structs of ``loss``, ``role`` and ``text``."""
    pieces = F.filter(F.split(text, r"\[/INST\]|</s>", -1), lambda p: F.length(p) > 0)

    def one(p: Column) -> Column:
        loss = F.startswith(p, F.lit(LOSS_OPEN))
        role = F.substring_index(F.when(loss, F.substring(p, len(LOSS_OPEN) + 1, 1 << 30)).otherwise(F.substring(p, len(OPEN) + 1, 1 << 30)), "\n", 1)
        start = F.when(loss, len(LOSS_OPEN)).otherwise(len(OPEN)) + F.length(role) + 2
        return F.struct(loss.alias("loss"), F.url_decode(role).alias("role"), unescaped(F.substr(p, start)).alias("text"))

    return F.transform(pieces, one)


def format_chats(rows: DataFrame, payload: str = "payload", mappings: tuple[Mapping, ...] = MAPPINGS, loss_role: str = LOSS_ROLE) -> DataFrame:
    """Canonical turns and ``formatted`` text for rows of any known layout.

    The loss mask of ``formatted`` covers exactly the escaped texts between
    ``<s>role\\n`` and ``</s>``.  All columns of ``rows`` stay, but for ``layout``, ``turns`` and
    ``formatted``, which are replaced.  An empty table gives an empty result.
    """
    return canonical_turns(rows, payload, mappings).withColumn("formatted", formatted(F.col("turns"), loss_role))


def gathered(messages: DataFrame) -> DataFrame:
    """Message rows (conv_id, turn, role, text) as one ``messages`` payload for each conversation.

    Turns are ordered by turn (null first), then role and text, so repeated turns
    have a fixed order.  Rows with a null conv_id make one conversation.  A conversation is
    one training example, so its turns meet in one row whatever their number.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("m"))
    return grouped.select("conv_id", F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def digests(formatted_rows: DataFrame) -> DataFrame:
    """What a training job can check of each formatted conversation, read back from its text."""
    turns = formatted_rows.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted")).alias("t"))
    said = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("t", lambda t: t["loss"]), lambda t: t["text"]), "")
    out = turns.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), loss.alias("loss"), "formatted_chars")
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
