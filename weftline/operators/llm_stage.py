"""Collecting a request's items, the answering stage and its cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.config import DEFAULT_PRICE, PRICES
from weftline.functions import text


def collect(requests: DataFrame, as_of: Column, extra: dict[str, DataFrame] | None = None) -> DataFrame:
    """(request_id, source, text, ts, pos): the message, the conversation's turns, oldest first, and what ``extra`` has by source.

    A turn's time is as many seconds before ``as_of`` as there are turns from it on.
    """
    cells = lambda df, source, t, ts, pos: df.select("request_id", F.lit(source).alias("source"), t.alias("text"), ts.cast("double").alias("ts"), pos.cast("int").alias("pos"))
    turns = requests.select("request_id", F.size("conversation").alias("n"), F.posexplode("conversation").alias("i", "t"))
    out = cells(requests, "user_message", F.col("user_message"), as_of, F.lit(0))
    out = out.unionByName(cells(turns, "current_conversation", F.col("t"), as_of - (F.col("n") - F.col("i")), F.col("i")))
    for source, df in (extra or {}).items():
        out = out.unionByName(cells(df, source, F.col("text"), as_of, F.coalesce(F.col("pos"), F.lit(0)) if "pos" in df.columns else F.lit(0)))
    return out


RESPONSE = "answer string, llm_model string, llm_backend string, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, retries int, tool_calls int"
RETRYABLE = ("rate limit", "429", "overloaded", "529", "500", "502", "503", "timeout", "timed out", "connection")


def retrying(call: Callable, tries: int = 4, first_s: float = 0.5, most_s: float = 8.0, sleep: Callable[[float], None] = time.sleep) -> tuple[object, int]:
    """What ``call`` gives and how many retries it took: waits double; errors that don't look passing are raised at once."""
    for k in range(tries):
        try:
            return call(), k
        except Exception as e:
            passing = isinstance(e, (TimeoutError, ConnectionError)) or any(x in str(e).lower() for x in RETRYABLE)
            if k + 1 == tries or not passing:
                raise
            sleep(min(most_s, first_s * 2**k))
    raise AssertionError


def run_tools(model: Callable, system: str, user: str, tools: dict[str, Callable], most: int = 6) -> dict:
    """A loop of model and tools: as long as the reply asks for tools, their results go back to it, ``most`` rounds at most.

    ``model(system, messages, names)`` replies with a dictionary of ``text``, or of ``calls``: (id, name, arguments). An
    unknown tool or one that fails gives its error as the result. Usage counts add up.
    """
    messages: list[dict] = [{"role": "user", "content": user}]
    total, calls = {"input_tokens": 0, "output_tokens": 0}, 0
    reply: dict = {}
    for _ in range(most):
        reply = model(system, messages, list(tools))
        for k in total:
            total[k] += reply.get(k, 0)
        if not reply.get("calls"):
            break
        messages.append({"role": "assistant", "content": reply.get("text", ""), "calls": reply["calls"]})
        for number, name, arguments in reply["calls"]:
            calls += 1
            try:
                result = str(tools[name](**arguments)) if name in tools else f"error: no tool called {name}"
            except Exception as e:  # the model is told
                result = f"error: {e}"
            messages.append({"role": "tool", "call": number, "content": result})
    return reply | total | {"text": reply.get("text") or "", "tool_calls": calls}


def flattened(system: str | list[dict]) -> str:
    """A system prompt of blocks as one text."""
    return system if isinstance(system, str) else "\n\n".join(b["text"] for b in system if b.get("text"))


def complete(built: DataFrame, client: Callable[[], Callable], tries: int = 4, tools: Callable[[], dict[str, Callable]] | None = None) -> DataFrame:
    """``built`` with the columns of ``RESPONSE``. A prompt that isn't ``ok`` gets none.

    ``client`` makes a model in each task. It is called with (system, user) and gives a text, or a dictionary of text, model,
    backend and usage counts; with ``tools``, as ``run_tools`` says. Where counts are missing they are estimated.
    """

    @F.pandas_udf(RESPONSE)
    def ask(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model, kit = client(), tools() if tools else None
        size = lambda t: max(1, (len(t) + 3) // 4)

        def one(system: str, user: str, ok: bool) -> tuple:
            if not ok:
                return (None,) * 9
            got, retries = retrying(lambda: run_tools(model, system, user, kit) if kit is not None else model(system, user), tries)
            r = got if isinstance(got, dict) else {"text": got}
            return (r.get("text", ""), r.get("model"), r.get("backend", "client"), r.get("input_tokens") or size(system) + size(user), r.get("output_tokens") or size(r.get("text", "")), r.get("cache_read_tokens", 0), r.get("cache_write_tokens", 0), retries, r.get("tool_calls", 0))

        names = [f.split()[0] for f in RESPONSE.split(", ")]
        for system, user, ok in batches:
            f = pd.DataFrame([one(s, u, k) for s, u, k in zip(system, user, ok)], columns=names)
            yield f.astype({c: "Int64" if c.endswith("tokens") else "Int32" for c in names[3:]})

    asked = built.withColumn("_wl_r", ask("system", "user", "ok" if "ok" in built.columns else F.lit(True)))
    return asked.select(*built.columns, "_wl_r.*")


def respond(built: DataFrame, client: Callable | None, tools: Callable | None = None) -> DataFrame:
    """``complete``, or without a client ``mock_answer``; a blocked prompt says why."""
    if client:
        out = complete(built, client, tools=tools)
    else:
        zero = lambda kind: F.lit(0).cast(kind)
        text_ = F.when(F.col("ok"), mock_answer("user"))
        out = built.withColumn("answer", text_).withColumns({"llm_model": F.lit(None).cast("string"), "llm_backend": F.when(F.col("ok"), F.lit("mock")), "input_tokens": F.col("prompt_tokens").cast("bigint"), "output_tokens": text.token_count("answer").cast("bigint"), "cache_read_tokens": zero("bigint"), "cache_write_tokens": zero("bigint"), "retries": zero("int"), "tool_calls": zero("int")})
    blocked = ~F.col("ok")
    out = out.withColumn("answer", F.when(blocked, F.concat(F.lit("[BLOCKED] "), F.array_join("errors", "; "))).otherwise(F.col("answer")))
    out = out.withColumn("llm_backend", F.when(blocked, "none").otherwise(F.col("llm_backend")))
    return out.withColumns({c: F.when(blocked, F.lit(0)).otherwise(F.col(c)) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "retries", "tool_calls")}).withColumn("from_cache", F.lit(False))


def from_cache(rows: DataFrame) -> DataFrame:
    """Rows with an ``answer`` that a cache held, and no tokens spent."""
    zero = {c: F.lit(0).cast("bigint") for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")}
    return rows.withColumns(zero | {"retries": F.lit(0), "tool_calls": F.lit(0), "llm_model": F.lit(None).cast("string"), "llm_backend": F.lit("cache"), "from_cache": F.lit(True)})


def finalize(answered: DataFrame, model: str, facts: dict) -> DataFrame:
    """A row of figures for each request; ``facts`` are the same for all of a batch. Only answers of a client cost."""
    rate = answered.agg(F.round(F.coalesce(F.avg(F.col("from_cache").cast("int")), F.lit(0.0)), 6).alias("cache_hit_rate"))
    spent = cost(F.coalesce("llm_model", F.lit(model)), F.col("input_tokens"), F.col("output_tokens"), F.col("cache_read_tokens"), F.col("cache_write_tokens"))
    own = answered.select(
        "request_id", "llm_backend", "cache_read_tokens", "prompt_tokens", "output_tokens", F.when(F.col("llm_backend").isin("mock", "none", "cache"), 0.0).otherwise(spent).alias("cost_usd"), F.col("n_items").alias("context_items_final"),
        F.size("injection_flags").alias("injection_flags"), "pii_redacted", F.round("confidence", 6).alias("retrieval_confidence"), "low_confidence", *[F.lit(v).alias(k) for k, v in facts.items()],
    )
    return own.crossJoin(F.broadcast(rate))  # one row


def mock_answer(user: str | Column) -> Column:
    """An answer without a model: the request, and the first four context lines."""
    c = F.col(user) if isinstance(user, str) else user
    lines = F.regexp_extract_all(c, F.lit(r"(?m)^(?:- |\[\d+\] )(.+)$"), F.lit(1))
    ask = F.trim(F.regexp_extract(c, r"(?s)<user_request>\s*(.+?)\s*</user_request>", 1))
    body = F.when(F.size(lines) > 0, F.array_join(F.transform(F.slice(lines, 1, 4), lambda x: F.concat(F.lit("  * "), x)), "\n")).otherwise("  (nothing in context)")
    return F.concat(F.lit("[no model]\n\nRequest: "), ask, F.lit("\n\n"), F.size(lines).cast("string"), F.lit(" context line(s), first:\n"), body)


def stream_tokens(df: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, pos, token): pieces whose concatenation is the answer."""
    parts = df.select(key, F.split(answer, " ").alias("_p"))
    return parts.select(key, F.size("_p").alias("_n"), F.posexplode("_p").alias("pos", "_t")).select(key, "pos", F.when(F.col("pos") < F.col("_n") - 1, F.concat("_t", F.lit(" "))).otherwise(F.col("_t")).alias("token"))


def cost(model: str | Column, tokens_in: Column, tokens_out: Column, cache_read: Column = None, cache_write: Column = None) -> Column:
    """US dollars: writing to a prompt cache costs a quarter more, reading from it a tenth."""
    zero = F.lit(0)
    read, write = zero if cache_read is None else cache_read, zero if cache_write is None else cache_write
    name = F.col(model) if isinstance(model, str) else model
    pick = lambda i: F.coalesce(*(F.when(name == m, F.lit(p[i])) for m, p in PRICES.items()), F.lit(DEFAULT_PRICE[i]))
    fresh = F.greatest(zero, tokens_in - read - write)
    return F.round(((fresh + 1.25 * write + 0.1 * read) * pick(0) + tokens_out * pick(1)) / 1e6, 6)


def metrics(answered: DataFrame, model: str = "medium") -> DataFrame:
    """(request_id, prompt_tokens, answer_tokens, n_items, ok, cost) for the log."""
    out = text.token_count("answer")
    return answered.select("request_id", "prompt_tokens", out.alias("answer_tokens"), "n_items", "ok", cost(F.lit(model), F.col("prompt_tokens"), out).alias("cost"))


def log_lines(rows: DataFrame) -> DataFrame:
    """Rows as JSON lines for an append-only log."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def audit_tail(log: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last ``n`` entries, oldest first."""
    return log.orderBy(*(F.desc(c) for c in order)).limit(n).orderBy(*order)


def fetch(requests: DataFrame, fetchers: dict[str, Callable[[str], str]], threads: int = 8) -> DataFrame:
    """(request_id, source, text): what every fetcher gives for every message, in parallel in each task as well.

    A fetcher that fails gives nothing for that request.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(job: tuple) -> tuple | None:
            request, source, message = job
            try:
                return request, source, fetchers[source](message)
            except Exception:  # one source's failure is not the batch's
                return None

        with ThreadPoolExecutor(threads) as pool:
            for f in frames:
                jobs = [(i, s, m) for i, m in zip(f["request_id"], f["user_message"]) for s in fetchers]
                yield pd.DataFrame([x for x in pool.map(one, jobs) if x], columns=["request_id", "source", "text"])

    kind = requests.schema["request_id"].dataType.simpleString()
    return requests.select("request_id", "user_message").mapInPandas(run, f"request_id {kind}, source string, text string")


def ask_each(df: DataFrame, prompt: Column, client: Callable[[], Callable[[str], str]], out: str) -> DataFrame:
    """``df`` with a model's reply to each row's prompt; null where it fails, so that callers can fall back."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = client()

        def once(p: str | None) -> str | None:
            try:
                return None if p is None else model(p)
            except Exception:  # the caller's fallback takes over
                return None

        for batch in batches:
            yield batch.map(once)

    return df.withColumn(out, ask(prompt))


def summarize(items: DataFrame, client: Callable[[], Callable[[str], str]], max_tokens: int, column: str = "text") -> DataFrame:
    """Items of too many tokens replaced by a model's summary; where it fails they stay."""
    long = text.token_count(column) > max_tokens
    asked = ask_each(items, F.when(long, F.concat(F.lit("Summarise, keep all facts:\n\n"), F.col(column))), client, "_wl_short")
    return asked.withColumn(column, F.coalesce("_wl_short", F.col(column))).drop("_wl_short")


def model_facts(exchanges: DataFrame, client: Callable[[], Callable[[str], str]]) -> DataFrame:
    """(request_id, fact, key, value, importance) that a model lists as JSON; other replies give no row."""
    prompt = F.concat(F.lit("List lasting facts about the user as a JSON array of {fact, key, value, importance}; [] if there are none.\n\nUser: "), F.substring("user_message", 1, 1000), F.lit("\nAnswer: "), F.substring(F.coalesce("answer", F.lit("")), 1, 1000))
    raw = ask_each(exchanges, prompt, client, "_wl_raw")
    listed = F.from_json(F.regexp_extract("_wl_raw", r"(?s)(\[.*\])", 1), "array<struct<fact:string,key:string,value:string,importance:double>>")
    return raw.select("request_id", F.explode(listed).alias("f")).select("request_id", "f.fact", "f.key", "f.value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("f.importance", F.lit(0.5)))).alias("importance"))


def judged(claims: DataFrame, client: Callable[[], Callable[[str], str]], key: str) -> DataFrame:
    """(key, claims, supported, groundedness): a claim counts as supported if the model's reply begins with yes."""
    prompt = F.concat(F.lit("Does the context support the claim? Answer YES or NO.\n\nContext:\n"), F.col("context"), F.lit("\n\nClaim: "), F.col("claim"))
    out = ask_each(claims, prompt, client, "_wl_yes")
    yes = F.count_if(F.coalesce(F.startswith(F.upper(F.trim("_wl_yes")), F.lit("YES")), F.lit(False)))
    return out.groupBy(key).agg(F.count("*").alias("claims"), yes.alias("supported")).withColumn("groundedness", F.round(F.col("supported") / F.col("claims"), 6))
