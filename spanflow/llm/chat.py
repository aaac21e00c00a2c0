"""Chat formatting by token-level assembly, and reading it back.

Every segment (a turn's text, or the name of a role without a mark of its own) is encoded by itself with a byte-level
vocabulary; the marks around it are reserved ids beyond that vocabulary, spliced in between, so that no text can encode
to a mark. Strings in a text that look like a mark are escaped all the same, since the output may also be written as
text: the first character of each is followed by one backslash more than it had, which is undone when read. The loss
mask is the running sum of +1 where an assistant's text begins and -1 where it ends. Token positions within the
conversation are running sums, too.

A row of the output is a turn: its ids with the marks, its mask and the position of its first token, so that a
conversation of any length is spread over rows; a task that writes or reads one holds a batch of turns at a time.

Defined cases: a null text or role counts as empty; turns are ordered by turn (null first), then role and text; rows that
repeat are turns of their own; a null conv_id is a conversation of its own, as is every other value; an empty table
gives an empty result; only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Fixed values of the template: the marks in the order of their reserved ids.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[OUT]", "[ROLE]", "[TEXT]")
#: A string of the vocabulary that its users may take for a mark.
OTHER = ("<|endoftext|>",)
BASE = 50257
AROUND = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("[OUT]", "</s>")}
ID = {m: BASE + k for k, m in enumerate(MARKS)}
_ANY = "|".join(f"{re.escape(m[0])}(\\\\*){re.escape(m[1:])}" for m in sorted((*MARKS, *OTHER), key=len, reverse=True))
_LIKE = re.compile(_ANY)
_ESCAPED = re.compile(_ANY.replace("(\\\\*)", "(\\\\+)"))


def escape(text: str) -> str:
    """No mark is left in the result, and unescape() gives the text back."""
    return _LIKE.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text) if "\\" in text else text


def _in_order(rows: DataFrame, *order) -> DataFrame:
    """A conversation's rows in one partition and in order; its id as text, since pandas has no null among integers."""
    return rows.withColumn("conv_id", F.col("conv_id").cast("string")).repartition("conv_id").sortWithinPartitions("conv_id", *order)


@lru_cache(maxsize=2)
def _encoder(vocabulary: str | None):
    """A vocabulary is read once by a Python worker, whatever number of tasks it runs."""
    from .packing import Encoder

    return Encoder(vocabulary)


def _ids(column: pd.Series) -> list:
    return [None if pd.isna(x) else x for x in column]


def format_conversations(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """conv_id, place, ids, mask, start of every turn: place from 0 in order, mask 1 for tokens that count for the loss,
    start the number of tokens of the conversation before these."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _in_order(rows, F.col("turn").asc_nulls_first(), "role", "text")

    def run(frames):
        encode = _encoder(vocabulary).encode
        last, place, before = object(), 0, 0  # of the conversation that the batch before ended in
        for pdf in frames:
            names = ["" if role in AROUND else escape(role) for role in pdf["role"]]
            pieces = encode([*map(escape, pdf["text"]), *names])
            bodies, names = pieces[: len(pdf)], pieces[len(pdf) :]
            out: list[tuple] = []
            for conv, role, body, name in zip(_ids(pdf["conv_id"]), pdf["role"], bodies, names, strict=True):
                if conv != last:
                    last, place, before = conv, 0, 0
                front = [ID["<s>"]] if not place else []
                opens, closes = AROUND.get(role, ("[ROLE]", "</s>"))
                front += [ID[opens]] if role in AROUND else [ID[opens], *name.tolist(), ID["[TEXT]"]]
                ids = np.concatenate((np.array(front, np.int32), body.astype(np.int32), np.array([ID[closes]], np.int32)))
                step = np.zeros(len(ids) + 1, np.int32)
                if role == "assistant":
                    step[len(front)] += 1
                    step[len(front) + len(body)] -= 1
                out.append((conv, place, ids, np.cumsum(step[:-1]), before))
                place, before = place + 1, before + len(ids)
            yield pd.DataFrame(out, columns=["conv_id", "place", "ids", "mask", "start"])

    made = rows.select("conv_id", "role", "text").mapInPandas(run, "conv_id string, place bigint, ids array<int>, mask array<int>, start bigint")
    return made.withColumn("conv_id", F.col("conv_id").cast(kind))


def parse_turn(ids: np.ndarray, mask: np.ndarray, decode) -> tuple[str, str, str, int]:
    """role, text, the text under the mask, and the number of characters of a turn's written form."""
    at = np.flatnonzero(ids >= BASE)
    marks = [MARKS[i - BASE] for i in ids[at]]
    parts = [decode(ids[a + 1 : b].tolist()).decode() for a, b in zip(at, [*at[1:], len(ids)], strict=True)]
    chars = sum(map(len, marks)) + sum(map(len, parts))
    if marks[0] == "<s>":
        marks, parts = marks[1:], parts[1:]
    role = unescape(parts[0]) if marks[0] == "[ROLE]" else next(r for r, (opens, _) in AROUND.items() if opens == marks[0])
    text = unescape(parts[-2])  # between the last two marks
    under = ids[mask > 0]
    return role, text, unescape(decode(under[under < BASE].tolist()).decode()), chars


def read_back(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """What the tokens say about each conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns come in order and go into running digests one by one."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    rows = _in_order(formatted.select("conv_id", "place", "ids", "mask"), "place")

    def run(frames):
        decode = _encoder(vocabulary).bpe.decode_bytes
        none = object()
        last, turns, loss, counts = none, None, None, [0, 0, 0]

        def row():
            return (last, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2])

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for pdf in frames:
            out = []
            for conv, ids, mask in zip(_ids(pdf["conv_id"]), pdf["ids"], pdf["mask"], strict=True):
                if conv != last or last is none:
                    if last is not none:
                        out.append(row())
                    last, turns, loss, counts = conv, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                role, text, under, chars = parse_turn(np.asarray(ids), np.asarray(mask), decode)
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(under.encode())
                counts = [counts[0] + 1, counts[1] + len(under), counts[2] + chars]
            yield pd.DataFrame(out, columns=names)
        if last is not none:
            yield pd.DataFrame([row()], columns=names)

    made = rows.mapInPandas(run, "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    return made.withColumn("conv_id", F.col("conv_id").cast(kind))


def checked_format(conversations: DataFrame) -> DataFrame:
    """Formats, writes the tokens to the shared folder, and reads them back."""
    stored = materialise(format_conversations(conversations))
    done = materialise(read_back(stored))
    discard(stored)
    return done
