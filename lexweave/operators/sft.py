"""Instruction and chat data: prompt templates, masking, truncation, padding, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions.text import strip

IGNORE = -100
#: Fixed value: the two prompt templates of instruction data.
WITH_INPUT = "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:\n"
WITHOUT_INPUT = "### Instruction:\n{instruction}\n\n### Response:\n"


def fill(template: str, **fields: Column) -> Column:
    """A template with {name} places filled by columns."""
    parts: list[Column] = []
    rest = template
    for name in sorted(fields, key=template.index if all("{" + n + "}" in template for n in fields) else None):
        place = "{" + name + "}"
        if rest.count(place) != 1:
            raise ValueError(f"the template must hold {place} once")
        before, rest = rest.split(place)
        parts += [F.lit(before), fields[name]]
    return F.concat(*parts, F.lit(rest))


def instruction_prompt(instruction: Column, input_: Column, with_input: str = WITH_INPUT, without_input: str = WITHOUT_INPUT) -> Column:
    """The prompt; a null or blank input takes the template without one."""
    said, given = strip(instruction), strip(F.coalesce(input_, F.lit("")))
    return F.when(given != "", fill(with_input, instruction=said, input=given)).otherwise(fill(without_input, instruction=said))


def masked(prompt: Column, response: Column) -> Column:
    """Labels: IGNORE over the prompt, then the response."""
    return F.concat(F.array_repeat(F.lit(IGNORE), F.size(prompt)), response)


def instruction_example(prompt: Column, response: Column, eos: int, max_length: int) -> dict[str, Column]:
    """input_ids, labels, attention_mask; a prompt of max_length or more is cut and stands alone, else the response is cut on the right."""
    prompt = F.slice(prompt, 1, max_length)
    answer = F.slice(F.array_append(response, F.lit(eos)), F.lit(1), F.lit(max_length) - F.size(prompt))
    ids = F.concat(prompt, answer)
    return {"input_ids": ids, "labels": masked(prompt, answer), "attention_mask": F.array_repeat(F.lit(1), F.size(ids))}


def sft_example(prompt: Column, response: Column, bos: int, eos: int, max_length: int) -> dict[str, Column]:
    """input_ids and labels, cut on the right to max_length; null where no label would be left."""
    begin = F.concat(F.array(F.lit(bos)), prompt)
    ids = F.concat(begin, F.array_append(response, F.lit(eos)))
    fits = F.size(begin) < max_length
    cut = lambda a: F.slice(a, 1, max_length)
    return {"input_ids": F.when(fits, cut(ids)), "labels": F.when(fits, cut(masked(begin, F.array_append(response, F.lit(eos)))))}


def chat_transcripts(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv and the prompt: a line per turn, the user's as User, any other's as Assistant, ending in an open answer."""
    line = F.concat(F.when(F.col(role) == "user", "User: ").otherwise("Assistant: "), F.coalesce(F.col(text), F.lit("")))
    said = F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), line.alias("l")))), lambda x: x["l"])
    return turns.groupBy(conv).agg(F.concat(F.array_join(said, "\n"), F.lit("\nAssistant:")).alias("prompt"))


def sft_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, turn, prompt, response: user turns that an assistant turn follows; blank ones are left out."""
    after = Window.partitionBy("conv_id").orderBy("turn")
    both = turns.withColumns({"_role": F.lead("role").over(after), "response": F.lead("text").over(after)})
    pairs = both.where("role = 'user' AND _role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), "response")
    return pairs.where((strip(F.col("prompt")) != "") & (strip(F.col("response")) != ""))


def until_eos(tokens: Column, eos: int) -> Column:
    """Tokens before the first eos."""
    at = F.array_position(tokens, eos)
    return F.when(at > 0, F.slice(tokens, F.lit(1), (at - 1).cast("int"))).otherwise(tokens)


def recovered_prompt(input_ids: Column, labels: Column) -> Column:
    """Tokens whose label is masked."""
    return F.transform(F.filter(F.arrays_zip(input_ids.alias("i"), labels.alias("l")), lambda x: x["l"] == IGNORE), lambda x: x["i"])


def pad_id(pad: int | None, eos: int) -> tuple[int, bool]:
    """(what to pad with, whether it is the end token for want of a pad token)."""
    return (eos, True) if pad is None else (pad, False)


def pad_batches(df: DataFrame, batch_size: int, pad: int = 0, order_col: str = "pos", drop_last: bool = False) -> DataFrame:
    """df in batches of batch_size rows in order: batch_id, input_ids and labels padded to the batch's longest, attention_mask."""
    from lexweave.functions.prefix import running
    from lexweave.functions.stored import stored

    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    placed = running(stored(df.withColumn("_one", F.lit(1))), [order_col], "_one", "_place").drop("_one")
    placed = placed.withColumn("batch_id", F.floor(F.col("_place") / batch_size)).drop("_place")
    batch = Window.partitionBy("batch_id")
    placed = placed.withColumns({"_longest": F.max(F.size("input_ids")).over(batch), "_rows": F.count("*").over(batch)})
    if drop_last:
        placed = placed.where(F.col("_rows") == batch_size)
    missing = F.col("_longest") - F.size("input_ids")
    filled = lambda name, value: F.concat(F.col(name), F.array_repeat(F.lit(value), missing))
    mask = F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), missing))
    return placed.withColumns({"attention_mask": mask, "labels": filled("labels", IGNORE), "input_ids": filled("input_ids", pad)}).drop("_longest", "_rows")


def sft_dataset(examples: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(stored examples that have input_ids, {total, kept, skipped}); ValueError if all were skipped."""
    from lexweave.functions.stored import stored

    rows = stored(examples)
    total, kept = rows.agg(F.count("*"), F.count("input_ids")).first()
    if not kept:
        raise ValueError(f"all {total} examples were skipped: no label is left at this length")
    return rows.where("input_ids IS NOT NULL"), {"total": total, "kept": kept, "skipped": total - kept}


def dataset_stats(examples: DataFrame) -> DataFrame:
    """total, kept, skipped as a row."""
    return examples.agg(F.count("*").alias("total"), F.count("input_ids").alias("kept")).withColumn("skipped", F.col("total") - F.col("kept"))


def write_dataset(examples: DataFrame, path: str) -> dict[str, int]:
    """Writes input_ids and labels as JSON lines; returns the counts."""
    kept, counts = sft_dataset(examples)
    kept.select("input_ids", "labels").write.json(path)
    return counts


def sample_prompts(examples: DataFrame, decode, n: int, order_col: str = "pos") -> DataFrame:
    """order_col, prompt: the first n prompts that aren't blank, decoded from masked tokens. decode: a column function from tokens to text."""
    if n <= 0:
        raise ValueError("n must be positive")
    found = examples.select(order_col, recovered_prompt(F.col("input_ids"), F.col("labels")).alias("_ids")).where(F.size("_ids") > 0)
    texts = found.select(order_col, decode(F.col("_ids")).alias("prompt")).where(strip(F.coalesce(F.col("prompt"), F.lit(""))) != "")
    return texts.orderBy(order_col).limit(n)


def epoch_order(df: DataFrame, seed: int, epoch: int, order_col: str = "pos") -> DataFrame:
    """df with `place`: its rank in the shuffle of an epoch, by a seeded hash. No task sorts all rows."""
    from lexweave.functions.prefix import running
    from lexweave.functions.stored import stored
    from lexweave.operators.split import seeded_hash

    marked = stored(df.withColumns({"_hash": seeded_hash(seed * 1_000_003 + epoch, order_col), "_one": F.lit(1)}))
    return running(marked, ["_hash", order_col], "_one", "place").drop("_hash", "_one")
