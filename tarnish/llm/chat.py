"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is a list of typed parts. A visitor, one method per type, turns each part into
its piece of the output: text as it is (escaped), anything else as a placeholder that stands in
the text where the part stood, with the attachment's reference and the number of tokens it will
expand to. The result is one row per conversation: its pieces in order, each with its loss mask
(the text of the assistant is learned, nothing else), and its attachments in order.

Control strings cannot be forged from inside a text: a backslash is doubled, and a bar that
follows ``<`` or begins a part gets a backslash in front, so ``<|`` occurs in control strings
only, and :func:`unescaped` gets the text back exactly.

Defined cases: null texts, roles and lists of parts are empty; a null type is text, an unknown
one a document; turns with equal numbers are ordered by role and content, null numbers first;
repeated rows are repeated turns; rows without an id are one conversation; an empty table has
none. Columns besides the named ones are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
PART = ("struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>")


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"(^|<)\|", r"$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escaped_role(role: Column) -> Column:
    """A role is one line: its line feeds become a backslash and an n."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    # a backslash before the n counts only if an even number of backslashes stands before it
    return unescaped(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


class Visitor:
    """What each type of part becomes: ``(text in the output, tokens it expands to)``.

    Text expands to itself, whose tokens only a tokenizer knows: null.
    """

    patch, audio_rate, page_tokens = 28, 25, 256

    def text(self, part: Column) -> tuple[Column, Column]:
        return escaped(F.coalesce(part["text"], F.lit(""))), F.lit(None).cast("bigint")

    def image(self, part: Column) -> tuple[Column, Column]:
        sides = [F.ceil(F.coalesce(part[side], F.lit(0)) / self.patch) for side in ("width", "height")]
        return F.lit("<|image|>"), (sides[0] * sides[1]).cast("bigint")

    def audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|audio|>"), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.audio_rate).cast("bigint")

    def document(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|document|>"), (F.coalesce(part["pages"], F.lit(0)) * self.page_tokens).cast("bigint")

    def kind(self, part: Column) -> Column:
        kind = F.coalesce(part["type"], F.lit("text"))
        return F.when(kind.isin("text", "image", "audio"), kind).otherwise("document")

    def visit(self, part: Column, learned: Column) -> Column:
        """``(kind, text, loss, ref, tokens)`` of one part."""
        kind = self.kind(part)
        seen = {name: getattr(self, name)(part) for name in ("text", "image", "audio", "document")}

        def pick(i: int) -> Column:
            choice = F.when(kind == "text", seen["text"][i])
            for name in ("image", "audio"):
                choice = choice.when(kind == name, seen[name][i])
            return choice.otherwise(seen["document"][i])
        return piece(kind, pick(0), learned & (kind == "text"), part["ref"], pick(1))


def piece(kind: Column, text: Column, loss: Column, ref: Column, tokens: Column) -> Column:
    return F.struct(kind.alias("kind"), text.alias("text"), F.coalesce(loss, F.lit(False)).alias("loss"),
                    ref.cast("string").alias("ref"), tokens.cast("bigint").alias("tokens"))


def text_part(text: Column) -> Column:
    """A list of one text part."""
    none = {name: F.lit(None).cast(kind) for name, kind in (
        ("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))}
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
                            *[c.alias(name) for name, c in none.items()]))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         parts: str = "parts", learned: str = "assistant", visitor: Visitor | None = None) -> DataFrame:
    """``(conv_id, pieces, attachments)``; ``parts`` is a list of :data:`PART`.

    One shuffle by conversation. The concatenated texts of the pieces are the formatted string
    (:func:`rendered`).
    """
    visitor = visitor or Visitor()
    none = F.array().cast(f"array<{PART}>")
    rows = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), F.struct(
        F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{parts}`"), none).alias("parts")).alias("turn"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    control, nothing = F.lit("control"), F.lit(None)

    def of_turn(t: Column) -> Column:
        head = piece(control, F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n")), F.lit(False), nothing, nothing)
        body = F.transform(t["parts"], lambda p: visitor.visit(p, t["role"] == learned))
        return F.concat(F.array(head), body, F.array(piece(control, F.lit(END), F.lit(False), nothing, nothing)))

    pieces = grouped.select("conv_id", F.flatten(F.transform("turns", of_turn)).alias("pieces"))
    attached = F.filter("pieces", lambda p: ~p["kind"].isin("control", "text"))
    return pieces.select("conv_id", "pieces", F.transform(attached, lambda p, i: F.struct(
        (i + 1).alias("place"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))).alias("attachments"))


def rendered(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "")


def learned_text(pieces: Column) -> Column:
    """All text under the loss mask, as it was."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescaped(p["text"])), "")


def parsed(formatted: Column) -> Column:
    """The turns of a formatted string, ``(role, text)`` each, as they were."""
    bodies = F.split(formatted, r"<\|im_end\|>\n", -1)
    whole = F.slice(bodies, F.lit(1), F.size(bodies) - 1)

    def turn(body: Column) -> Column:
        halves = F.split(F.substr(body, F.lit(len(START) + 1)), "\n", 2)
        return F.struct(unescaped_role(halves[0]).alias("role"), unescaped(halves[1]).alias("text"))
    return F.transform(whole, turn)
