"""Language-model services behind replaceable clients, with a cache table.

A client is a picklable callable prompt -> text that raises on failure. The model is asked in pandas batches on the
executors; answers are nondeterministic and costly, so `ask` returns a checkpointed frame.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkloom.cache import AnswerCache
from silkloom.functions.responses import json_part, message_content
from silkloom.storage import ensure_checkpoint_dir

Client = Callable[[str], str]
CACHE = "key string, value string, timestamp timestamp"
TTL = "1 day"


def post_json(url: str, payload: dict, headers: dict[str, str], timeout: float = 30.0) -> dict:
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


@dataclass(frozen=True)
class HttpClient:
    """A service that takes a JSON request. kind says how the prompt is sent and the answer read; the key is read from the
    executor's environment when it is used, so that no secret is in a plan."""

    kind: str
    url: str
    model: str
    key_variable: str | None = None
    system: str = ""
    options: dict = field(default_factory=dict)
    post: Callable[..., dict] = post_json

    def __call__(self, prompt: str) -> str:
        key = os.environ.get(self.key_variable, "") if self.key_variable else ""
        payload = request_payload(self.kind, self.model, prompt, self.system, self.options)
        return read_answer(self.kind, self.post(self.url, payload, {"Authorization": f"Bearer {key}"} if key else {}))


def request_payload(kind: str, model: str, prompt: str, system: str = "", options: dict | None = None) -> dict:
    """chat: messages, the system one only if it is not empty; inference: inputs; generate: prompt without a stream."""
    if kind == "chat":
        messages = [{"role": "system", "content": system}] if system else []
        return {"model": model, "messages": [*messages, {"role": "user", "content": prompt}], **(options or {})}
    if kind == "inference":
        return {"inputs": prompt, **({"parameters": options} if options else {})}
    if kind == "generate":
        return {"model": model, "prompt": prompt, "stream": False, **(options or {})}
    raise ValueError(f"unknown kind of service: {kind}")


def read_answer(kind: str, answer: dict | list) -> str:
    if kind == "chat":
        return answer["choices"][0]["message"]["content"]
    if kind == "generate":
        return answer["response"]
    first = answer[0] if isinstance(answer, list) and answer else answer
    return str(first.get("generated_text", first)) if isinstance(first, dict) else str(first)


#: Default models by service.
MODELS = {"mistral": "mistral-tiny", "deepseek": "deepseek-chat", "huggingface": "mistralai/Mistral-7B-v0.1", "ollama": "mistral", "thai": "wangchanberta"}


#: Short names of Thai models.
THAI_MODELS = {"wangchanberta": "airesearch/wangchanberta-base-att-spm-uncased", "thaibert": "monsoon-nlp/bert-base-thai", "xlm-roberta-thai": "xlm-roberta-base"}


def thai_client(name: str = "wangchanberta", hub: str = "https://api-inference.huggingface.co/models") -> HttpClient:
    """A Thai model by its short or full name."""
    model = THAI_MODELS.get(name, name)
    return HttpClient("inference", f"{hub}/{model}", model, "HUGGINGFACE_API_KEY")


def default_services() -> dict[str, HttpClient]:
    hub = "https://api-inference.huggingface.co/models"
    return {
        "mistral": HttpClient("chat", "https://api.mistral.ai/v1/chat/completions", MODELS["mistral"], "MISTRAL_API_KEY"),
        "deepseek": HttpClient("chat", "https://api.deepseek.com/v1/chat/completions", MODELS["deepseek"], "DEEPSEEK_API_KEY"),
        "huggingface": HttpClient("inference", f"{hub}/{MODELS['huggingface']}", MODELS["huggingface"], "HUGGINGFACE_API_KEY"),
        "ollama": HttpClient("generate", "http://localhost:11434/api/generate", MODELS["ollama"]),
        "thai": thai_client(MODELS["thai"]),
    }


def with_fallback(clients: dict[str, Client], names: list[str] | None = None) -> Callable[[str], str | None]:
    """The first answer of the named clients in order, or None if all fail."""
    chosen = [clients[n] for n in (names or list(clients))]

    def ask_all(prompt: str) -> str | None:
        for client in chosen:
            try:
                return client(prompt)
            except Exception:  # noqa: BLE001, S112  the next one is asked
                continue
        return None

    return ask_all


def verify_access(clients: dict[str, Client], prompt: str = "ping") -> dict[str, bool]:
    found = {}
    for name, client in clients.items():
        try:
            client(prompt)
            found[name] = True
        except Exception:  # noqa: BLE001
            found[name] = False
    return found


def cache_key(service: str, model: str, prompt: Column) -> Column:
    """Service, model and prompt together name an answer."""
    return F.concat_ws(":", F.lit(service), F.lit(model), prompt)


def cached(keys: DataFrame, cache: DataFrame, now: Column | None = None, ttl: str = TTL) -> DataFrame:
    """keys (key) with value: the newest answer younger than ttl, null where there is none or an empty one."""
    now = F.current_timestamp() if now is None else now
    live = cache.where(F.col("timestamp") > now - F.expr(f"interval {ttl}")).where("value <> ''")
    newest = live.groupBy("key").agg(F.max_by("value", "timestamp").alias("value"))
    return keys.join(newest, "key", "left")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The newest row of each key."""
    both = cache.unionByName(new)
    return both.groupBy("key").agg(F.max_by("value", "timestamp").alias("value"), F.max("timestamp").alias("timestamp"))


def ask(prompts: DataFrame, client: Callable[[str], str | None], prompt: str = "prompt") -> DataFrame:
    """prompts with response and error, asked once and checkpointed. Equal prompts of a batch are asked once."""
    ensure_checkpoint_dir(prompts.sparkSession)

    @F.pandas_udf("struct<response:string,error:string>")
    def answers(batch: pd.Series) -> pd.DataFrame:
        known: dict = {}
        for p in batch:
            if p not in known:
                try:
                    known[p] = (client(p), None) if p is not None else (None, "no prompt")
                except Exception as e:  # noqa: BLE001  a failed call is a row
                    known[p] = (None, f"{type(e).__name__}: {e}")
        return pd.DataFrame([known[p] for p in batch], columns=["response", "error"])

    return prompts.withColumn("__a", answers(prompt)).select(*prompts.columns, "__a.response", "__a.error").checkpoint()


def ask_cached(prompts: DataFrame, client: Callable[[str], str | None], cache: DataFrame, service: str, model: str, prompt: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """prompts with response and error, and the cache with the new answers: only prompts without a live answer are asked."""
    keyed = prompts.withColumn("key", cache_key(service, model, F.col(prompt)))
    known = cached(keyed.select("key").distinct(), cache)
    misses = keyed.join(known.where("value is not null"), "key", "left_anti").select("key", prompt).dropDuplicates(["key"])
    asked = ask(misses, client, prompt)
    new = asked.where("response is not null").select("key", F.col("response").alias("value"), F.current_timestamp().alias("timestamp"))
    told = known.where("value is not null").select("key", F.col("value").alias("response"), F.lit(None).cast("string").alias("error")).union(asked.select("key", "response", "error"))
    return keyed.join(told, "key").drop("key"), upsert(cache, new)


def ask_through(prompts: DataFrame, client: Callable[[str], str | None], cache: AnswerCache, service: str, model: str, prompt: str = "prompt") -> DataFrame:
    """prompts with response and error; what a bucketed cache holds is not asked, and new answers are kept there."""

    def asked(rows: DataFrame) -> DataFrame:
        told = ask(rows.select("key", prompt), client, prompt)
        return told.select("key", F.col("response").alias("value"), "error")

    return cache.through(prompts, asked, cache_key(service, model, F.col(prompt))).withColumnRenamed("value", "response")


def parse_samples(answers: DataFrame, schema: str, required: tuple[str, ...], response: str = "response") -> DataFrame:
    """answers with sample, the JSON of the response read by schema, and error where it is missing or incomplete."""
    read = answers.withColumn("sample", F.from_json(json_part(response), schema))
    whole = F.lit(True)
    for f in required:
        whole = whole & F.col(f"sample.{f}").isNotNull()
    missing = F.when(~whole, F.lit("Missing required fields in response"))
    error = F.coalesce(F.col("error"), missing) if "error" in answers.columns else missing
    return read.withColumn("error", error).withColumn("sample", F.when(whole, F.col("sample")))


def contents(answers: DataFrame, response: str = "response") -> DataFrame:
    """answers of a raw chat endpoint with their message content as response."""
    return answers.withColumn(response, message_content(response))
