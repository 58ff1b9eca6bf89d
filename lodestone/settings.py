"""Defaults of the engine.  The figures are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

CHUNK_CHARS, CHUNK_OVERLAP, CODE_CHUNK_CHARS = 800, 150, 1600
HYBRID_CONTEXT_CHARS, HYBRID_GRAPH_SHARE, HYBRID_GRAPH_NODES, LEAST_ROOM = 5000, 0.6, 3, 400
MAX_HISTORY_MESSAGES, HISTORY_MAX_CHARS, HISTORY_OLD_MESSAGE_CHARS = 6, 1500, 400
MAX_BOOST, BOOST_PER_TERM = 0.25, 0.12
AMBIGUOUS_LIMIT, LIST_CAP = 5, 12
DOC_CHARS = 140
UPDATE_INTERVAL_S, MODEL_LIST_TTL_S = 0.08, 15.0

#: Fixed values.
STOP_TERMS = ("the", "and", "for", "how", "what", "with", "this", "that", "from", "does", "use", "are", "who", "why")
#: Fixed values.
EMBEDDING_HINTS = ("embed", "minilm", "bge", "e5-")
#: Fixed values.
FILE_ICONS = {"pdf": "📕", "docx": "📘", "txt": "📄", "md": "📝", "py": "🐍"}
#: Fixed values.
DEFAULT_ICON = "📄"
#: Fixed values.
SUPPORTED_TYPES = ("pdf", "docx", "txt", "md", "py")
#: Names of methods that containers and strings have.
COMMON_METHODS = (
    "append", "extend", "insert", "remove", "pop", "clear", "copy", "index", "count", "sort", "reverse",
    "get", "set", "add", "update", "items", "keys", "values", "setdefault", "discard", "union",
    "join", "split", "strip", "lstrip", "rstrip", "replace", "format", "startswith", "endswith",
    "lower", "upper", "encode", "decode", "find", "read", "write", "close", "open", "seek",
)
#: Fixed values.
IMPACT_KEYWORDS = ("กระทบ", "impact", "ถ้าแก้", "หากแก้", "ผลกระทบ", "affect")


@dataclass(frozen=True)
class Session:
    """Settings of one session."""

    chat_model: str | None = None
    embed_model: str = "nomic-embed-text"
    use_rag: bool = True
    mode: str = "hybrid"
    top_k: int = 4
    min_score: float = 0.3
    use_mmr: bool = True
    mmr_lambda: float = 0.7
    graph_depth: int = 3
    temperature: float = 0.5
    num_ctx: int = 8192
    system_prompt: str = "You answer briefly, clearly and kindly."
