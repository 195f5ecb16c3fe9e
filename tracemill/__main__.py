"""Command line: ``python -m tracemill generate|prepare|compress|merge|stats|export|prompts ...`` with the usual flags of these stages.

Models are named by factories, ``package.module:function``: what a generator, a scorer or a provider is, ``providers`` says.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from .functions.text import DEFAULT_EOS, REASON_PROMPT
from .operators.compress import Gate
from .plans import runs


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tracemill")
    sub = top.add_subparsers(dest="stage", required=True)

    p = sub.add_parser("generate", help="problem records to traces")
    p.add_argument("--model_path", required=True, help="names the output folder")
    p.add_argument("--data_path", required=True)
    p.add_argument("--output_dir", required=True)
    p.add_argument("--dataset", required=True)
    p.add_argument("--generator", required=True, help="factory of the model: called with the flags, makes prompts -> [(text, tokens)]")
    p.add_argument("--num_samples", type=int)
    for name, default in (("max_new_tokens", 8192), ("batch_size", 32)):
        p.add_argument(f"--{name}", type=int, default=default)
    p.add_argument("--temperature", type=float, default=0.6)
    p.add_argument("--top_p", type=float, default=0.95)

    p = sub.add_parser("prepare", help="filter traces by answer and length, sample them by level")
    p.add_argument("--input_path", "--data_path", dest="input_path", required=True)
    p.add_argument("--output_path", required=True)
    for name, default in (("num_per_level", 500), ("max_length", 8192), ("seed", 42)):
        p.add_argument(f"--{name}", type=int, default=default)
    p.add_argument("--num_samples", type=int)
    p.add_argument("--tokenizer_path", "--model_path", dest="tokenizer_path", help="a tokenizers JSON file, for traces without a stored length")

    p = sub.add_parser("prompts", help="problem records to prompts")
    p.add_argument("--data_path", required=True)
    p.add_argument("--output_path", required=True)
    p.add_argument("--num_samples", type=int)

    p = sub.add_parser("compress", help="greedy compression of traces, resumed where it stopped")
    p.add_argument("--data_path", required=True)
    p.add_argument("--output_dir", required=True)
    p.add_argument("--scorer", required=True, help="factory: called with the flags, maps a frame with steps to one with step_scores")
    p.add_argument("--provider", required=True, help="factory of a provider: called with the flags (and the chat client, or None) in each task")
    for name, default in (("tau_low", 0.3), ("tau_high", 0.1), ("tau_sim", 0.7)):
        p.add_argument(f"--{name}", type=float, default=default)
    p.add_argument("--enable_rewrite", action="store_true")
    p.add_argument("--enable_fuse", action="store_true")
    for name in ("model_path", "similarity_model_path", "api_key", "api_base", "api_model"):
        p.add_argument(f"--{name}")
    for name in ("num_samples", "shard_id", "num_shards"):
        p.add_argument(f"--{name}", type=int)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--canonical_path", help="also merge the shards and copy all results there")

    p = sub.add_parser("merge", help="unite shard results")
    p.add_argument("--input_path", required=True)
    p.add_argument("--output_path", required=True)
    p.add_argument("--single_file", action="store_true")

    p = sub.add_parser("stats", help="averages over compressed traces")
    p.add_argument("--input_path", required=True)

    p = sub.add_parser("export", help="refine compressed traces and write training entries")
    p.add_argument("--input_file", required=True)
    p.add_argument("--output_file", required=True)
    p.add_argument("--model", required=True)
    for name in ("api_key", "api_base", "chat"):
        p.add_argument(f"--{name}")
    p.add_argument("--limit", type=int)
    p.add_argument("--num_workers", type=int, default=16)
    p.add_argument("--max_tokens", type=int, default=8192)
    p.add_argument("--temperature", type=float, default=0.0)
    p.add_argument("--eos_token", default=DEFAULT_EOS)
    p.add_argument("--reason_prompt", default=REASON_PROMPT)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    {"generate": _generate, "prepare": _prepare, "prompts": _prompts, "compress": _compress, "merge": _merge, "stats": _stats, "export": _export}[a.stage](spark, a)


def _generate(spark, a) -> None:
    from .providers import load_factory

    make = load_factory(a.generator)
    print(runs.save_generated(spark, a.data_path, a.output_dir, a.dataset, a.model_path, lambda: make(a), a.num_samples, a.batch_size))


def _prepare(spark, a) -> None:
    counter = None
    if a.tokenizer_path:
        from .providers import token_counter

        counter = token_counter(lambda path=a.tokenizer_path: _tokenizer(path))
    settings = runs.Prepare(a.num_per_level, a.max_length, a.seed, a.num_samples)
    runs.prepare(spark, a.input_path, settings, counter)[1].show()
    print(runs.save_prepared(spark, a.input_path, a.output_path, settings, counter))


def _prompts(spark, a) -> None:
    from .sources.jsonl import write_jsonl

    write_jsonl(runs.prompts(spark, a.data_path, a.num_samples), a.output_path, order=["ordinal"])


def _compress(spark, a) -> None:
    from .providers import chat_client, load_factory, set_seed

    key, base = a.api_key or os.environ.get("OPENAI_API_KEY"), a.api_base or os.environ.get("OPENAI_BASE_URL")
    asks = a.enable_rewrite or a.enable_fuse
    if asks and not (key and a.api_model):
        raise ValueError("rewriting and fusing need --api_key (or OPENAI_API_KEY) and --api_model")
    make, score = load_factory(a.provider), load_factory(a.scorer)

    def provider():
        set_seed(a.seed)
        return make(a, chat_client(a.api_model, key, **({"base_url": base} if base else {})) if asks else None)

    gate = Gate(a.tau_low, a.tau_high, a.tau_sim, a.enable_rewrite, a.enable_fuse)
    target = runs.save_compressed(spark, a.data_path, a.output_dir, provider, lambda df: score(a, df), gate, a.num_samples, a.shard_id, a.num_shards)
    runs.stats(spark, target).show()
    print(target)
    if a.canonical_path:
        print(runs.publish(spark, runs.compressed_paths(a.output_dir, a.data_path)[1], a.canonical_path))


def _merge(spark, a) -> None:
    runs.merge(spark, a.input_path, a.output_path, a.single_file)


def _stats(spark, a) -> None:
    runs.stats(spark, a.input_path).show()


def _export(spark, a) -> None:
    from .providers import chat_client, load_factory

    key, base = a.api_key or os.environ.get("OPENAI_API_KEY"), a.api_base or os.environ.get("OPENAI_BASE_URL")
    if a.chat:
        make = load_factory(a.chat)
        client = lambda: make(a)
    elif key:
        client = lambda: chat_client(a.model, key, max_tokens=a.max_tokens, temperature=a.temperature, **({"base_url": base} if base else {}))
    else:
        raise ValueError("refining needs --api_key (or OPENAI_API_KEY)")
    print(runs.export_sft(spark, a.input_file, client, a.output_file, a.limit, a.eos_token, a.reason_prompt, a.num_workers))


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    return lambda text: len(made.encode(text, add_special_tokens=False).ids)


if __name__ == "__main__":
    main()
