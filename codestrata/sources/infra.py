"""Facts of infrastructure files: Dockerfiles, Kubernetes manifests, Helm charts and workflow files.

Same fact rows as the code extractors: nodes are declarations named `<kind>.<name>`, references keep their
kind and raw target; `operators/references.py` resolves them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.ids import base_name
from codestrata.session import spread
from codestrata.sources.extract import _COLUMNS, _DTYPES, FACT_SCHEMA

try:
    import yaml
except ImportError:  # the YAML flavours then give no facts
    yaml = None


def flavour(path: Column, source: Column) -> Column:
    """dockerfile, actions, helm, k8s or plain; null for other files."""
    base = base_name(path)
    is_yaml = path.rlike(r"\.ya?ml$")
    docker = base.isin("Dockerfile", "Containerfile") | base.rlike(r"^Dockerfile\..+")
    helm = path.rlike(r"(^|/)templates/.*\.(ya?ml|tpl)$") | base.rlike(r"^(Chart|values)\.ya?ml$")
    k8s = source.rlike(r"(?m)^apiVersion:\s*\S") & source.rlike(r"(?m)^kind:\s*\S")
    return (
        F.when(docker, "dockerfile")
        .when(path.rlike(r"(^|/)\.github/workflows/[^/]+\.ya?ml$") | base.rlike(r"^action\.ya?ml$"), "actions")
        .when(is_yaml & helm, "helm")
        .when(is_yaml & k8s, "k8s")
        .when(is_yaml, "plain")
    )


class _Facts(list):
    def __init__(self, repo: str, file: str):
        super().__init__()
        self.repo, self.file = repo, file

    def node(self, kind: str, name: str, line: int, end: int | None = None, exported: bool = False, parent: str | None = None) -> str:
        full = f"{kind}.{name}"
        self.append({"repo": self.repo, "file": self.file, "fact": "decl", "name": full, "kind": kind, "signature": full, "exported": exported, "start_line": line, "end_line": end or line, "parent": parent})
        return full

    def ref(self, kind: str, caller: str | None, callee: str, line: int) -> None:
        self.append({"repo": self.repo, "file": self.file, "fact": "ref", "kind": kind, "caller": caller, "callee": callee, "line": line})


def docker_instructions(text: str) -> Iterator[tuple[int, str, str]]:
    """(line, instruction, arguments) with continued lines joined and comments left out."""
    lines = text.splitlines()
    i = 0
    while i < len(lines):
        start, parts = i, []
        while i < len(lines):
            line = lines[i].strip()
            i += 1
            if line.startswith("#"):
                continue
            if line.endswith("\\"):
                parts.append(line[:-1])
                continue
            parts.append(line)
            break
        joined = " ".join(p.strip() for p in parts if p.strip())
        if joined:
            word, _, rest = joined.partition(" ")
            yield start + 1, word.upper(), rest.strip()


def dockerfile_facts(repo: str, file: str, text: str) -> list[dict]:
    out = _Facts(repo, file)
    stages: list[str] = []
    current = None
    last = text.count("\n") + 1
    for line, word, rest in docker_instructions(text):
        words = [w for w in rest.split() if not w.startswith("--")]
        flags = dict(w[2:].partition("=")[::2] for w in rest.split() if w.startswith("--"))
        if word == "FROM" and words:
            alias = words[2] if len(words) > 2 and words[1].upper() == "AS" else f"~{len(stages)}"
            current = out.node("stage", alias, line, exported=True)
            image = words[0]
            if "$" not in image:
                earlier = next((s for s in stages if s.lower() == image.lower()), None)
                out.ref("from-image", current, f"stage.{earlier}" if earlier else f"ext:image/{image}", line)
            stages.append(alias)
        elif word in ("ARG", "ENV") and words:
            pairs = re.findall(r"([A-Za-z_]\w*)=", rest) or [words[0]]
            for name in pairs if word == "ENV" else [words[0].split("=")[0]]:
                out.append({"repo": repo, "file": file, "fact": "decl", "name": f"{word.lower()}.{name}", "kind": "const", "signature": f"{word} {name}", "exported": False, "start_line": line, "end_line": line})
        elif word in ("COPY", "ADD") and words:
            if "from" in flags:
                source = flags["from"]
                target = next((s for i, s in enumerate(stages[:-1]) if s.lower() == source.lower() or source == str(i)), None)
                out.ref("copy-from", current, f"stage.{target}" if target else f"ext:image/{source}", line)
            else:
                for path in words[:-1]:
                    out.ref("config", current, path, line)
    if stages:
        out.node("image", "final", last, exported=True)
    return list(out)


def blank_templates(text: str) -> str:
    """Helm's {{ … }} spans become filler of the same length; lines that hold nothing else become blank."""
    blanked = re.sub(r"\{\{.*?\}\}", lambda m: re.sub(r"[^\n]", "x", m.group()), text, flags=re.DOTALL)
    return "\n".join(" " * len(line) if re.fullmatch(r"\s*\{\{[^}]*\}\}\s*", old) else line for line, old in zip(blanked.split("\n"), text.split("\n")))


def _plain(node):
    """A YAML node as dicts, lists and strings; no tags are run."""
    if isinstance(node, yaml.MappingNode):
        return {str(k.value): _plain(v) for k, v in node.value if isinstance(k, yaml.ScalarNode)}
    if isinstance(node, yaml.SequenceNode):
        return [_plain(v) for v in node.value]
    return node.value if node is not None else None


def _documents(text: str) -> list[tuple[object, int, int]]:
    """(value, first line, last line) of each document; none where the text is no YAML."""
    try:
        return [(_plain(n), n.start_mark.line + 1, max(n.start_mark.line + 1, n.end_mark.line)) for n in yaml.compose_all(text, Loader=yaml.SafeLoader) if n is not None]
    except (yaml.YAMLError, RecursionError):
        return []


def _walk(value, path=()) -> Iterator[tuple[tuple, object]]:
    yield path, value
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _walk(v, (*path, k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _walk(v, (*path, i))


# Where a manifest names another object, and that object's kind.
_CONFIG_KEYS = {"configMapRef": "ConfigMap", "configMapKeyRef": "ConfigMap", "secretRef": "Secret", "secretKeyRef": "Secret", "configMap": "ConfigMap", "secret": "Secret", "persistentVolumeClaim": "PersistentVolumeClaim"}


def label_text(labels: dict) -> str:
    return ",".join(f"{k}={v}" for k, v in sorted(labels.items()) if isinstance(v, str))


def kubernetes_facts(repo: str, file: str, text: str) -> list[dict]:
    out = _Facts(repo, file)
    for doc, first, last in _documents(text):
        if not isinstance(doc, dict) or not isinstance(doc.get("kind"), str):
            continue
        meta = doc.get("metadata") if isinstance(doc.get("metadata"), dict) else {}
        name = f"{doc['kind']}.{meta.get('name') or '~1'}"
        me = out.node("resource", name, first, last)
        spec = doc.get("spec") if isinstance(doc.get("spec"), dict) else {}
        template = spec.get("template") if isinstance(spec.get("template"), dict) else doc if doc["kind"] == "Pod" else {}
        pod = template.get("metadata") if isinstance(template.get("metadata"), dict) else {}
        if isinstance(pod.get("labels"), dict):
            out[-1]["specifier"] = label_text(pod["labels"])  # the labels its pods carry
        if doc["kind"] == "Service" and isinstance(spec.get("selector"), dict):
            out.ref("selector", me, label_text(spec["selector"]), first)
        for path, value in _walk(doc):
            key = path[-1] if path else None
            if key == "image" and isinstance(value, str) and any(p in ("containers", "initContainers") for p in path):
                out.node("image", value, first)
                out.ref("from-image", me, f"ext:image/{value}", first)
            elif key in _CONFIG_KEYS and isinstance(value, dict):
                target = value.get("name") or value.get("secretName") or value.get("claimName")
                if isinstance(target, str):
                    out.ref("config-ref", me, f"{_CONFIG_KEYS[key]}/{target}", first)
    return list(out)


def helm_facts(repo: str, file: str, text: str) -> list[dict]:
    base = file.rpartition("/")[2]
    if base.startswith("Chart."):
        out = _Facts(repo, file)
        for doc, first, last in _documents(text):
            if isinstance(doc, dict) and isinstance(doc.get("name"), str):
                out.node("module", doc["name"], first, last)
        return list(out)
    if base.startswith("values."):
        out = _Facts(repo, file)
        for doc, first, _ in _documents(text):
            for key in doc if isinstance(doc, dict) else ():
                line = next((i for i, t in enumerate(text.splitlines(), 1) if t.startswith(f"{key}:")), first)
                out.node("variable", key, line, exported=True)
        return list(out)
    found = kubernetes_facts(repo, file, blank_templates(text))
    out = _Facts(repo, file)
    me = next((f["name"] for f in found if f["fact"] == "decl" and f["kind"] == "resource"), None)
    for match in re.finditer(r"\{\{[^}]*?\.Values\.([\w.]+)", text):
        out.ref("helm-values", me, match.group(1), text.count("\n", 0, match.start()) + 1)
    return found + list(out)


def actions_facts(repo: str, file: str, text: str) -> list[dict]:
    out = _Facts(repo, file)
    for doc, first, last in _documents(text):
        if not isinstance(doc, dict):
            continue
        jobs = doc.get("jobs") if isinstance(doc.get("jobs"), dict) else {"runs": doc["runs"]} if isinstance(doc.get("runs"), dict) else {}
        for job, body in jobs.items():
            if not isinstance(body, dict):
                continue
            line = next((i for i, t in enumerate(text.splitlines(), 1) if t.strip().startswith(f"{job}:")), first)
            called = isinstance(body.get("uses"), str)
            me = out.node("task" if called else "job", str(job), line, exported=True)
            needs = body.get("needs") or []
            for other in [needs] if isinstance(needs, str) else needs:
                if other != job:
                    out.ref("needs", me, str(other), line)
            if called:
                out.ref("uses", me, body["uses"], line)
            for i, step in enumerate(body.get("steps") or []):
                if not isinstance(step, dict):
                    continue
                node = out.node("step", f"{job}.~{i}", line, parent=me)
                if isinstance(step.get("uses"), str):
                    out.ref("uses", node, step["uses"], line)
                if isinstance(step.get("run"), str):
                    run = re.sub(r"\$\{\{.*?\}\}", " ", step["run"])
                    for token in dict.fromkeys(re.findall(r"[\w.@/-]*[\w-]/[\w./-]+|[\w-]+\.(?:sh|py|js|ts|ya?ml|json)\b", run)):
                        out.ref("config", node, token.removeprefix("./"), line)
    return list(out)


_READERS = {"dockerfile": dockerfile_facts, "k8s": kubernetes_facts, "helm": helm_facts, "actions": actions_facts}


def _batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in rows:
        found = []
        for repo, path, kind, source in zip(*(batch[c].tolist() for c in ("repo", "path", "flavour", "source"))):
            if kind == "dockerfile" or yaml is not None:
                found += _READERS[kind](repo, path, source)
        yield pd.DataFrame({c: pd.Series([f.get(c) for f in found], dtype=_DTYPES.get(c, object)) for c in _COLUMNS})


def infra_facts(files: DataFrame) -> DataFrame:
    """Facts of the infrastructure files among files (repo, path, source); others, null sources and broken YAML give none."""
    rows = files.where("source is not null and path is not null").select("repo", "path", flavour(F.col("path"), F.col("source")).alias("flavour"), "source")
    return spread(rows.where(F.col("flavour").isin(*_READERS))).mapInPandas(_batches, FACT_SCHEMA)
