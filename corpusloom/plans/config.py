"""What experiments are named and what their parameters may be."""

from __future__ import annotations

from collections.abc import Collection

# Fixed values.
LANGUAGES = ("ar", "de", "en", "es", "fr", "hi", "it", "ja", "ko", "pt", "ru", "th", "zh")
LABEL_LANGUAGES = ("en", "zh", "ar", "hi", "bn", "fa", "ja", "ko", "fr", "de", "ru", "es", "id")
TASKS = ("qa", "long-doc")
DOMAINS = ("wiki", "web", "healthcare", "law", "arxiv", "science", "news", "finance", "msmarco", "book")
SEGMENTS = ("no_segment", "easy_chunk", "chunk", "bert", "bge_small", "bge_base")
AIR_SEGMENTS = ("easy_chunk", "chunk_with_title")


def chosen(given: str | Collection[str] | None, allowed: Collection[str], what: str) -> list[str]:
    """The given values, or all where none are given; anything else is an error."""
    if given is None:
        return list(allowed)
    values = [given] if isinstance(given, str) else list(given)
    if wrong := [v for v in values if v not in allowed]:
        raise ValueError(f"unknown {what}: {', '.join(wrong)}")
    return values


def encoder_name(path: str) -> str:
    """A model path's last part; of a checkpoint, its parent's as well."""
    parts = path.rstrip("/").split("/")
    return "_".join(parts[-2:]) if parts[-1].startswith("checkpoint-") and len(parts) > 1 else parts[-1]


def index_path(root: str, encoder: str, segment: str, lang: str) -> str:
    return "/".join([root, encoder_name(encoder), chosen(segment, SEGMENTS, "segment method")[0], lang])


def run_path(root: str, encoder: str, segment: str, lang: str, real_doc: bool = False, reranker: str | None = None, shard: tuple[int, int] | None = None) -> str:
    """Where a run lies: of a search, or with a reranker of its (shard's) result."""
    models = encoder_name(encoder) + (f"-{encoder_name(reranker)}" if reranker else "")
    part = f"_{shard[0]}-of-{shard[1]}" if shard else ""
    return f"{root}/{models}/{segment}/{lang}{part}{'_real_doc' if real_doc else ''}.txt"


def chunk_folder(segment: str, max_length: int, keep_title: bool, overlap: int) -> str:
    return f"{segment}_{max_length}_{keep_title}_{overlap}"


def label_path(task: str, domain: str, lang: str, dataset: str) -> str:
    return "/".join([chosen(task, TASKS, "task")[0], chosen(domain, DOMAINS, "domain")[0], chosen(lang, LABEL_LANGUAGES, "language")[0], dataset])
