"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import settings


#: Unicode white space, and the four separators that count as such.
WHITE_SPACE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    """Without white space (Unicode) at either end."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def folded(c: Column | str) -> Column:
    """Lower case without hyphens and underscores: the form in which terms are matched."""
    return F.replace(F.replace(F.lower(c), F.lit("-"), F.lit("")), F.lit("_"), F.lit(""))


def query_terms(query: Column) -> Column:
    """Distinct folded terms of a question: Latin words of three characters or more, without stop terms."""
    words = F.regexp_extract_all(query, F.lit(r"[A-Za-z][A-Za-z0-9_\-]{2,}"), F.lit(0))
    terms = F.transform(words, folded)
    return F.array_distinct(F.filter(terms, lambda t: (F.length(t) >= 3) & ~t.isin(*settings.STOP_TERMS)))


def query_prefix(model: Column | str) -> Column:
    """What a model wants before a question."""
    m = F.lower(model)
    return F.when(m.contains("nomic-embed"), "search_query: ").when(m.contains("mxbai-embed"), "Represent this sentence for searching relevant passages: ").otherwise("")


def document_prefix(model: Column | str) -> Column:
    """What a model wants before a passage."""
    return F.when(F.lower(model).contains("nomic-embed"), "search_document: ").otherwise("")


def rendered(content: Column | str) -> Column:
    """HTML of a message: escaped, then bold, inline code and line breaks."""
    c = F.col(content) if isinstance(content, str) else content
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    c = F.regexp_replace(c, r"\*\*(.+?)\*\*", "<strong>$1</strong>")
    c = F.regexp_replace(c, r"`([^`\n]+)`", "<code>$1</code>")
    return F.replace(c, F.lit("\n"), F.lit("<br>"))


def file_icon(name: Column | str) -> Column:
    icons = F.create_map(*(F.lit(x) for pair in settings.FILE_ICONS.items() for x in pair))
    return F.coalesce(F.try_element_at(icons, F.lower(F.substring_index(name, ".", -1))), F.lit(settings.DEFAULT_ICON))


def flat_name(path: Column | str) -> Column:
    """Dotted name of a file in a package: ``a/b/__init__.py`` is ``a.b.py``."""
    return F.replace(F.regexp_replace(path, r"(^|/)__init__\.py$", ".py"), F.lit("/"), F.lit("."))


def module_name(file: Column | str) -> Column:
    """File name without its last extension, with dots between its parts."""
    bare = F.regexp_replace(file, r"(?<=.)\.[^./\\]*$", "")
    return F.regexp_replace(bare, r"[/\\]", ".")
