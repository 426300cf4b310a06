"""Which tool calls would flood a context, and which files a command wrote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Starts of harmless commands, marks of commands with much output, marks of written files in outputs.
SAFE_STARTS = ("git status", "git branch", "git checkout", "git add", "git commit", "git push", "git pull", "mkdir", "rm ", "mv ", "cp ", "cd ", "echo ", "pwd", "which ", "whoami")
LARGE_OUTPUTS = ("git log", "git diff", "find ", "cat ", "head -", "tail -", "ls -la", "ls -R", "tree ", "npm test", "cargo test", "pytest", "make ", "cargo build")
WRITTEN_MARKS = ("File created at: ", "File created at ", "Created: ", "Created ", "Wrote: ", "Wrote ", "Written to: ", "Written to ")
NOTE_FOLDERS = ("obsidian", "tasks/", "outputs/")


def decision(tool: Column, command: Column) -> Column:
    """'block' for a web fetch and for a command that likely prints much, unless it begins harmlessly; else 'approve'."""
    safe, large = F.lit(False), F.lit(False)
    for s in SAFE_STARTS:
        safe = safe | F.startswith(command, F.lit(s))
    for s in LARGE_OUTPUTS:
        large = large | F.contains(command, F.lit(s))
    shell = F.coalesce((tool == "Bash") & large & ~safe, F.lit(False))
    return F.when((tool == "WebFetch") | shell, "block").otherwise("approve")


def message(command: Column) -> Column:
    """The command as a message shows it."""
    return F.when(F.length(command) > 80, F.concat(F.substring(command, 1, 77), F.lit("..."))).otherwise(command)


_PATH = r"""\s*(?:"(/[^"]+)"|'(/[^']+)'|(/[^\s;|&),]+))"""


def _after(text: Column, mark: str) -> Column:
    """Absolute paths, quoted or plain, right after each place of the mark."""
    whole = F.regexp_extract_all(text, F.lit(mark + _PATH), F.lit(0))
    path = lambda x: F.coalesce(*[F.nullif(F.regexp_extract(x, mark + _PATH, k), F.lit("")) for k in (1, 2, 3)])
    return F.transform(whole, path)


def written_paths(tool: Column, file_path: Column, command: Column, output: Column) -> Column:
    """Absolute paths that a call wrote: of a write or an edit its file; of a command redirects, tee, the target of a copy or a
    move, what its output says was created, and notes that it names."""
    import re

    none = F.array().cast("array<string>")
    cmd, out = F.coalesce(command, F.lit("")), F.coalesce(output, F.lit(""))
    words = F.filter(F.split(F.trim(cmd), r"\s+"), lambda w: w != "")
    target = F.when((F.startswith(F.trim(cmd), F.lit("cp ")) | F.startswith(F.trim(cmd), F.lit("mv "))) & F.startswith(F.element_at(words, -1), F.lit("/")), F.array(F.element_at(words, -1))).otherwise(none)
    marks = F.concat(*[_after(out, re.escape(m)) for m in WRITTEN_MARKS])
    named = F.filter(F.regexp_extract_all(out, F.lit(r"""(?=(/[^\s;|&)"',(]+))"""), F.lit(1)), lambda p: F.endswith(p, F.lit(".md")) & (F.contains(p, F.lit(NOTE_FOLDERS[0])) | F.contains(p, F.lit(NOTE_FOLDERS[1])) | F.contains(p, F.lit(NOTE_FOLDERS[2]))))
    shell = F.concat(_after(cmd, ">>?"), _after(cmd, r"(?<![A-Za-z0-9_])tee (?:-a )?"), target, marks, named)
    edit = F.when(file_path.isNotNull(), F.array(file_path)).otherwise(none)
    return F.when(tool.isin("Write", "Edit"), edit).when(tool == "Bash", F.array_distinct(shell)).otherwise(none)
