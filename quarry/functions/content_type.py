"""Whether a text is code, prose or binary, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.paths import extension
from quarry.functions.text import is_binary

#: Extensions that decide at once (fixed values).
CODE_EXTENSIONS = [
    ".cpp", ".h", ".hpp", ".c", ".cc", ".cxx", ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".cs", ".php", ".rb", ".go", ".rs",
    ".swift", ".kt", ".scala", ".m", ".mm", ".html", ".css", ".scss", ".xml", ".json", ".yaml", ".yml", ".sh", ".bash", ".sql",
]
TEXT_EXTENSIONS = [".md", ".txt", ".rst", ".tex", ".org", ".adoc"]
#: Signs of code in a line (fixed patterns).
CODE_LINES = [
    r"\b(class|struct|interface|enum|trait)\s+\w+",
    r"\b(def|function|func|fn|lambda|const\s+\w+\s*=\s*\([^)]*\)\s*=>)\s*",
    r"\b(public|private|protected|static|final|virtual|override|async|await)\b",
    r"^[ \t]*(#include|#import|import\s+\{|from\s+\S+\s+import|using\s+\w+)",
    r"\b(var|let|const|auto|int|float|double|bool|void|string)\s+\w+\s*[=;:]",
    r"\bif\s*\(.*\)\s*\{|\bfor\s*\(.*\)|\bwhile\s*\(",
    r"=>\s*\{|function\s*\(|:\s*function",
    r"^\s*[\{\}]\s*$",
    r"^[ \t]*/[/*]|^[ \t]*\*|^[ \t]*//",
]
ANY_CODE = "|".join(f"(?:{p})" for p in CODE_LINES)
SCANNED, FENCED = 200, 75


def content_type(text: Column, uri: Column) -> Column:
    """'binary', 'code' or 'text'. Only the first 200 lines are scanned; ratios are over lines that aren't blank."""
    ext = F.lower(extension(uri))
    lines = F.slice(F.split(text, "\n"), 1, SCANNED)
    worded = F.filter(lines, lambda x: F.rlike(x, F.lit(r"[^ \t\r\n]")))
    flags = F.transform(
        worded,
        lambda x: F.struct(
            F.rlike(x, F.lit(r"\A[ \t\r\n]")).cast("int").alias("indent"), F.rlike(x, F.lit(ANY_CODE)).cast("int").alias("code"),
            F.rlike(x, F.lit(r"[{}]")).cast("int").alias("brace"), F.contains(x, F.lit(";")).cast("int").alias("semi"),
        ),
    )
    zero = F.struct(*[F.lit(0).alias(k) for k in ("indent", "code", "brace", "semi", "before")])
    # before: signs among all lines but the last, for the early decision
    sums = F.aggregate(
        flags, zero,
        lambda a, x: F.struct(*[(a[k] + x[k]).alias(k) for k in ("indent", "code", "brace", "semi")], a["code"].alias("before")),
    )
    # computed once per row, then named; where the extension decides, not at all
    facts = F.struct(F.size(worded).alias("n"), sums.alias("s"))
    by_lines = F.element_at(F.transform(F.array(facts), lambda f: _decide(text, f)), 1)
    return F.when(is_binary(text), "binary").when(ext.isin(CODE_EXTENSIONS), "code").when(ext.isin(TEXT_EXTENSIONS), "text").otherwise(by_lines)


def _decide(text: Column, f: Column) -> Column:
    n, s = f["n"], f["s"]
    fences = F.size(F.filter(F.slice(F.split(text, "\n"), 1, FENCED), lambda x: F.startswith(x, F.lit("```")))) >= 2
    short = F.contains(text, F.lit("{")) | F.contains(text, F.lit("function")) | F.contains(text, F.lit("class "))
    ratio = {k: s[k] / n for k in ("indent", "code", "brace", "semi")}
    strong = (
        (ratio["code"] > 0.25) | ((ratio["brace"] > 0.15) & (s["code"] > 2)) | ((ratio["semi"] > 0.2) & (s["code"] > 2)) | ((s["code"] > 5) & (ratio["indent"] > 0.5))
    )
    weak = (ratio["code"] > 0.1) & (ratio["indent"] > 0.6) & ((ratio["brace"] > 0.05) | (ratio["semi"] > 0.1))
    code, prose = F.lit("code"), F.lit("text")
    return (
        F.when((n >= 10) & (s["before"] >= 5), code).when(n < 3, F.when(short, code).otherwise(prose))
        .when(fences, prose).when(strong | weak, code).otherwise(prose)
    )
