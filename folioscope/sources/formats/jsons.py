"""Formats over JSON: generic values, logs, bills of material, API descriptions, event logs."""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..files import Format, loads, text

#: A key that holds one of these in lower case, without - and _, has its value masked.
SENSITIVE = ("token", "secret", "password", "apikey", "authorization", "cookie", "session", "credential")
DEPTH = 100


def kind_of(v) -> str:
    return {type(None): "null", bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}.get(type(v), "string")


def step(key: str) -> str:
    """A simple key after a dot, any other quoted in brackets."""
    quoted = key.replace("\\", "\\\\").replace('"', '\\"')
    return f".{key}" if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", key) else f'["{quoted}"]'


def leaves(v, path: str = "$", depth: int = 0) -> Iterator[tuple]:
    """(path, kind, value) of every leaf at any depth; empty containers are leaves."""
    if depth > DEPTH:
        raise ValueError("nested too deeply")
    if isinstance(v, dict) and v:
        for k, x in v.items():
            yield from leaves(x, path + step(str(k)), depth + 1)
    elif isinstance(v, list) and v:
        for i, x in enumerate(v):
            yield from leaves(x, f"{path}[{i}]", depth + 1)
    else:
        yield path, kind_of(v), {"array": "[]", "object": "{}"}.get(kind_of(v), v)


def records(data: bytes) -> Iterator[tuple]:
    """(record, path, kind, value) of text sequences and of one value a line; a bad record has its kind "invalid"."""
    s = text(data)
    for n, part in enumerate(p for p in (s.split("\x1e") if "\x1e" in s else s.splitlines()) if p.strip()):
        try:
            value = loads(part.encode())
        except ValueError:
            yield n, None, "invalid", None
            continue
        for row in leaves(value):
            yield n, *row


def at(v, path: str, default=None):
    for k in path.split("."):
        if not isinstance(v, dict):
            return default
        v = v.get(k)
    return default if v is None else v


def many(v) -> list:
    return v if isinstance(v, list) else [] if v is None else [v]


def uri(s):
    """The text, or what stands for one that looks like an address."""
    return "[uri]" if isinstance(s, str) and "://" in s else s


def masked(url: str) -> str:
    head, mark, query = (url or "").partition("?")
    hide = lambda k: any(x in k.lower().replace("-", "").replace("_", "") for x in SENSITIVE)
    return head + mark + "&".join(p.partition("=")[0] + "=***" if hide(p.partition("=")[0]) else p for p in query.split("&")) if mark else head


def joined(values, sep: str = ", ") -> str:
    return sep.join(str(x) for x in values if x not in (None, ""))


def cyclonedx(v) -> Iterator[tuple]:
    if v.get("bomFormat") != "CycloneDX":
        raise ValueError("not CycloneDX")
    todo = [at(v, "metadata.component"), *many(v.get("components"))]
    while todo:
        c = todo.pop(0)
        if c:
            yield c.get("type"), joined([c.get("group"), c.get("name")], "/"), c.get("version"), c.get("scope")
            todo = many(c.get("components")) + todo
    for s in many(v.get("services")):
        yield "service", s.get("name"), s.get("version"), None


def spdx(v) -> Iterator[tuple]:
    if "spdxVersion" not in v:
        raise ValueError("not SPDX")
    yield "document", v.get("SPDXID"), v.get("name"), v.get("spdxVersion")
    for p in many(v.get("packages")):
        yield "package", p.get("SPDXID"), p.get("name"), p.get("versionInfo")
    for f in many(v.get("files")):
        yield "file", f.get("SPDXID"), f.get("fileName"), None
    for r in many(v.get("relationships")):
        yield "relationship", r.get("spdxElementId"), r.get("relationshipType"), r.get("relatedSpdxElement")


def har(v) -> Iterator[tuple]:
    total = 0.0
    for e in v["log"]["entries"]:
        q, r = e.get("request", {}), e.get("response", {})
        total += max(0.0, float(e.get("time") or 0))
        yield q.get("method"), masked(q.get("url")), joined([r.get("status"), at(r, "content.mimeType")], " "), f"{q.get('bodySize', -1)} / {r.get('bodySize', -1)}", e.get("time")
    yield "total", None, None, None, total


def terraform(v) -> Iterator[tuple]:
    for c in v["resource_changes"]:
        yield c.get("address"), c.get("type"), joined(many(at(c, "change.actions"))), c.get("module_address"), c.get("action_reason")


def otlp(v) -> Iterator[tuple]:
    kinds = (("resourceSpans", "scopeSpans", "spans"), ("resourceMetrics", "scopeMetrics", "metrics"), ("resourceLogs", "scopeLogs", "logRecords"))
    if not any(k in v for k, _, _ in kinds):
        raise ValueError("no OTLP signal")
    for outer, scopes, inner in kinds:
        for r in many(v.get(outer)):
            service = next((at(a, "value.stringValue") for a in many(at(r, "resource.attributes")) if a.get("key") == "service.name"), None)
            for s in many(r.get(scopes)):
                rows = many(s.get(inner))
                yield inner.removesuffix("Records").rstrip("s"), service, at(s, "scope.name"), len(rows), joined(sorted({k for x in rows for k in x}))


def cloudevents(v) -> Iterator[tuple]:
    for e in many(v):
        if "specversion" not in e:
            raise ValueError("not a CloudEvent")
        data = kind_of(e["data"]) if "data" in e else "binary" if "data_base64" in e else None
        yield e.get("type"), e.get("id"), joined([uri(e.get("source")), e.get("time"), e.get("subject"), data], " · ")


def stix(v) -> Iterator[tuple]:
    if v.get("type") != "bundle":
        raise ValueError("not a STIX bundle")
    for o in many(v.get("objects")):
        yield o.get("type"), o.get("id"), joined([o.get("created"), o.get("modified")], " / "), joined(many(o.get("labels"))), joined(sorted(k for k in o if k not in ("type", "id", "created", "modified", "labels")))


def taxii(v) -> Iterator[tuple]:
    for key in ("api_roots", "collections", "objects", "versions"):
        for x in many(v.get(key)):
            x = x if isinstance(x, dict) else {"id": uri(x)}
            yield key.rstrip("s"), x.get("id") or x.get("title"), x.get("version") or len(many(x.get("media_types"))) or None, x.get("title") or x.get("type")
    if "title" in v and not v.get("collections"):
        yield "discovery", v.get("title"), len(many(v.get("api_roots"))), v.get("description")


def openapi(v) -> Iterator[tuple]:
    if not ("openapi" in v or "swagger" in v):
        raise ValueError("not OpenAPI")
    for path, item in (v.get("paths") or {}).items():
        for method in ("get", "put", "post", "delete", "options", "head", "patch", "trace"):
            if op := (item or {}).get(method):
                yield f"{method.upper()} {path}", op.get("operationId"), op.get("summary"), joined(op.get("responses") or {})


def asyncapi(v) -> Iterator[tuple]:
    if "asyncapi" not in v:
        raise ValueError("not AsyncAPI")
    for name, c in (v.get("channels") or {}).items():
        for action in ("publish", "subscribe"):
            if op := c.get(action):
                yield name, joined([action, op.get("operationId")], " / "), op.get("summary"), len(many(at(op, "message.oneOf"))) or int("message" in op)
        if "messages" in c:
            yield name, "channel", c.get("summary"), len(c["messages"])
    for name, op in (v.get("operations") or {}).items():
        yield at(op, "channel.$ref", name), joined([op.get("action"), name], " / "), op.get("summary"), len(many(op.get("messages")))


def postman(v) -> Iterator[tuple]:
    def walk(items, folder):
        for i in many(items):
            name = joined([folder, i.get("name")], " / ")
            if "item" in i:
                yield name, None, None, f"{len(i['item'])} items", None
                yield from walk(i["item"], name)
            elif "request" in i:
                q = i["request"] if isinstance(i["request"], dict) else {"method": "GET", "url": i["request"]}
                url = q.get("url")
                url = url.get("raw") if isinstance(url, dict) else url
                yield name, q.get("method"), masked(url), len(many(i.get("response"))), joined([at(q, "auth.type"), f"{len(many(i.get('event')))} scripts" if i.get("event") else None])

    if "info" not in v:
        raise ValueError("not a collection")
    yield from walk(v.get("item"), None)


def avro(v) -> Iterator[tuple]:
    def walk(s, path):
        if isinstance(s, str):
            yield path, "type", s
        elif isinstance(s, list):
            yield path, "union", joined(x if isinstance(x, str) else x.get("type") for x in s)
            for i, x in enumerate(s):
                if isinstance(x, dict):
                    yield from walk(x, f"{path}[{i}]")
        else:
            kind = s.get("type")
            name = joined([path, s.get("name")], ".")
            if kind in ("record", "error"):
                yield name, kind, f"{len(s.get('fields', []))} fields"
                for f in s.get("fields", []):
                    if isinstance(f["type"], str):
                        yield f"{name}.{f['name']}", "field", f["type"]
                    else:
                        yield from walk(f["type"], f"{name}.{f['name']}")
            elif kind == "enum":
                yield name, kind, joined(s.get("symbols", []))
            elif kind in ("array", "map"):
                yield name, kind, joined([s.get("items" if kind == "array" else "values")])
            elif isinstance(kind, (dict, list)):
                yield from walk(kind, path)
            else:
                yield name, kind, joined([s.get("logicalType"), s.get("size")])

    if isinstance(v, dict) and "protocol" in v:
        yield v["protocol"], "protocol", f"{len(v.get('messages', {}))} messages"
        for t in many(v.get("types")):
            yield from walk(t, "")
        for m, x in (v.get("messages") or {}).items():
            yield m, "message", joined([x.get("response")])
    else:
        yield from walk(v, "")


def csl(v) -> Iterator[tuple]:
    for e in many(v):
        people = [joined([a.get("family"), a.get("given")]) or a.get("literal") for a in many(e.get("author"))]
        dates = many(at(e, "issued.date-parts"))
        yield e.get("id"), e.get("type"), e.get("title"), joined(people, "; "), dates[0][0] if dates and dates[0] else at(e, "issued.raw")


def fhir(v) -> Iterator[tuple]:
    if "resourceType" not in v:
        raise ValueError("not FHIR")
    for r in [v, *(e.get("resource") or {} for e in many(v.get("entry")))]:
        if r:
            yield r.get("resourceType"), r.get("id"), r.get("status") or (r.get("type") if isinstance(r.get("type"), str) else None), len(many(at(r, "meta.profile"))), joined(sorted(k for k in r if k not in ("resourceType", "id", "meta", "text")))


def iiif(v) -> Iterator[tuple]:
    label = lambda x: x if isinstance(x, str) else joined(t for k in (x or {}) for t in many(x[k])) if isinstance(x, dict) else joined(many(x))
    yield "manifest", None, label(v.get("label")), v.get("type") or v.get("@type")
    canvases = many(v.get("items")) or [c for s in many(v.get("sequences")) for c in many(s.get("canvases"))]
    for n, c in enumerate(canvases, 1):
        yield "canvas", n, label(c.get("label")), f"{c.get('width')}x{c.get('height')}"
    for n, r in enumerate(many(v.get("structures")), 1):
        yield "range", n, label(r.get("label")), len(many(r.get("items")) or many(r.get("canvases")))
    for m in many(v.get("metadata")):
        yield "metadata", None, label(m.get("label")), label(m.get("value"))


def json_api(v) -> Iterator[tuple]:
    for kind in ("data", "included"):
        for r in many(v.get(kind)):
            yield kind, joined([r.get("type"), r.get("id")], " / "), None, joined(sorted(r.get("attributes") or {})), joined(sorted(r.get("relationships") or {}))
    for e in many(v.get("errors")):
        yield "error", e.get("id"), e.get("status"), e.get("title"), None


def jsonfeed(v) -> Iterator[tuple]:
    if "jsonfeed.org" not in str(v.get("version")):
        raise ValueError("not a JSON Feed")
    for i in many(v.get("items")):
        authors = many(i.get("authors")) or many(i.get("author"))
        yield i.get("id"), i.get("title"), i.get("content_text") or re.sub(r"<[^>]*>", "", i.get("content_html") or ""), i.get("date_published"), joined(a.get("name") for a in authors), len(many(i.get("attachments")))


def jsonld(v) -> Iterator[tuple]:
    count = 0

    def walk(node):
        nonlocal count
        subject = node.get("@id")
        if subject is None:
            subject, count = f"_:b{count}", count + 1
        for k, x in node.items():
            if k in ("@id", "@context", "@graph"):
                continue
            for o in many(x):
                if isinstance(o, dict) and "@value" in o:
                    yield subject, k, o["@value"]
                elif isinstance(o, dict):
                    inner = list(walk(o))
                    yield subject, k, o.get("@id") or (inner[0][0] if inner else f"_:b{count}")
                    yield from inner
                else:
                    yield subject, k, o

    for top in many(v):
        for node in many(top.get("@graph")) if "@graph" in top else [top]:
            yield from walk(node)


def merge_patch(v) -> Iterator[tuple]:
    def walk(x, path, depth):
        for k, y in x.items():
            here = path + "/" + k.replace("~", "~0").replace("/", "~1")
            yield here, "remove" if y is None else "merge" if isinstance(y, dict) else "set", kind_of(y), depth
            if isinstance(y, dict):
                yield from walk(y, here, depth + 1)

    if isinstance(v, dict):
        yield from walk(v, "", 1)
    else:
        yield "", "replace", kind_of(v), 0


def json_patch(v) -> Iterator[tuple]:
    for n, o in enumerate(v, 1):
        if o["op"] not in ("add", "remove", "replace", "move", "copy", "test"):
            raise ValueError(f"operation {o['op']}")
        yield n, o["op"], o["path"], o.get("from"), kind_of(o["value"]) if "value" in o else None


def json_schema(v) -> Iterator[tuple]:
    def walk(s, path):
        if not isinstance(s, dict):
            return
        need = s.get("required") or []
        facts = [joined(many(s.get("type")), "|"), s.get("format"), s.get("$ref"), f"enum({len(s['enum'])})" if "enum" in s else None, f"required({joined(need)})" if need else None]
        yield path, joined(facts, "; ")
        for group in ("properties", "$defs", "definitions", "patternProperties"):
            for k, x in (s.get(group) or {}).items():
                yield from walk(x, f"{path}/{group}/{k}")
        for one in ("items", "additionalProperties", "not", "if", "then", "else"):
            if isinstance(s.get(one), dict):
                yield from walk(s[one], f"{path}/{one}")
        for group in ("allOf", "anyOf", "oneOf"):
            for i, x in enumerate(many(s.get(group))):
                yield from walk(x, f"{path}/{group}/{i}")

    yield from walk(v, "#")


def ocel(v) -> Iterator[tuple]:
    for t in many(v.get("eventTypes")):
        yield "event type", t.get("name"), None, len(many(t.get("attributes"))), None
    for t in many(v.get("objectTypes")):
        yield "object type", t.get("name"), None, len(many(t.get("attributes"))), None
    for e in many(v["events"]):
        yield "event", e.get("id"), e.get("type"), e.get("time"), len(many(e.get("relationships")))
    for o in many(v.get("objects")):
        yield "object", o.get("id"), o.get("type"), len(many(o.get("attributes"))), len(many(o.get("relationships")))


def openlabel(v) -> Iterator[tuple]:
    body = v["openlabel"]
    for k in sorted(body):
        x = body[k]
        yield k, len(x) if isinstance(x, (dict, list)) else 1, joined(sorted({y.get("type") for y in x.values() if isinstance(y, dict) and y.get("type")})) if isinstance(x, dict) else None


def sarif(v) -> Iterator[tuple]:
    levels = ("error", "warning")
    counts: dict[tuple, list[int]] = {}
    for run in v["runs"]:
        driver = run["tool"]["driver"]
        rules = many(driver.get("rules"))
        by_id = {r.get("id"): r for r in rules}
        for r in many(run.get("results")):
            i = r.get("ruleIndex")
            rule = rules[i] if isinstance(i, int) and 0 <= i < len(rules) else by_id.get(r.get("ruleId"), {})
            name = r.get("ruleId") or rule.get("id") or "(none)"
            level = r.get("level") or at(rule, "defaultConfiguration.level") or "warning"
            got = counts.setdefault((driver.get("name"), name), [0, 0, 0])
            got[levels.index(level) if level in levels else 2] += 1
    for (tool, rule), n in sorted(counts.items()):
        yield tool, rule, *n, sum(n)


def kubernetes(docs) -> Iterator[tuple]:
    def objects(v):
        return many(v.get("items")) if str(v.get("kind", "")).endswith("List") and "items" in v else [v]

    for n, doc in enumerate(docs, 1):
        for o in objects(doc):
            if "kind" not in o or "apiVersion" not in o:
                raise ValueError("not a Kubernetes object")
            secret = f"{len(o.get('data') or o.get('stringData') or {})} secret values omitted" if o["kind"] == "Secret" else None
            yield joined([o["kind"], at(o, "metadata.name")], "/"), o["apiVersion"], joined(sorted(o.get("spec") or {})), secret or joined(sorted(o.get("status") or {})), n


def compose(v) -> Iterator[tuple]:
    for name, s in v["services"].items():
        s = s or {}
        build = s.get("build")
        ports = [p if not isinstance(p, dict) else joined([p.get("published"), p.get("target")], ":") for p in many(s.get("ports"))]
        volumes = [x if not isinstance(x, dict) else joined([x.get("source"), x.get("target")], ":") for x in many(s.get("volumes"))]
        depends = s.get("depends_on")
        rest = [joined(s.get("networks") or []), "privileged" if s.get("privileged") else None, "command" if s.get("command") else None]
        yield name, s.get("image") or (build.get("context") if isinstance(build, dict) else build), joined(ports), joined(depends or []), joined(volumes), joined(rest, "; ")


def actions(v) -> Iterator[tuple]:
    for name, j in v["jobs"].items():
        steps = many(j.get("steps"))
        needs = joined(many(j.get("needs")))
        yield name, joined(many(j.get("runs-on"))), joined([f"needs {needs}" if needs else None, f"if {j['if']}" if "if" in j else None], "; "), joined([f"{len(steps)} steps" if steps else None, joined(sorted({s["uses"] for s in steps if "uses" in s}))], ": ") or j.get("uses")


def jupyter(v) -> Iterator[tuple]:
    """Cells' source and text outputs; nothing is run."""
    whole = lambda x: "".join(x) if isinstance(x, list) else x or ""
    if v.get("nbformat", 0) < 4:
        raise ValueError("notebook format below 4")
    for n, c in enumerate(v["cells"], 1):
        yield c["cell_type"], n, whole(c.get("source"))
        for o in many(c.get("outputs")):
            said = whole(o.get("text")) or whole((o.get("data") or {}).get("text/plain")) if o.get("output_type") != "error" else joined([o.get("ename"), o.get("evalue")], ": ")
            yield "output", n, said


def chart(v) -> Iterator[tuple]:
    labels = many(v.get("labels")) or many(at(v, "data.labels"))
    series = many(v.get("datasets")) or many(v.get("series")) or many(at(v, "data.datasets"))
    if not series:
        raise ValueError("no series")
    for s in series:
        for i, x in enumerate(many(s.get("data")) or many(s.get("values"))):
            yield v.get("type"), s.get("label") or s.get("name"), labels[i] if i < len(labels) else i + 1, x


def excalidraw(v) -> Iterator[tuple]:
    for e in v["elements"]:
        if not e.get("isDeleted"):
            yield e.get("id"), e.get("type"), e.get("x"), e.get("y"), e.get("width"), e.get("height"), e.get("text"), at(e, "startBinding.elementId"), at(e, "endBinding.elementId")


def cityjson(v) -> Iterator[tuple]:
    if v.get("type") not in ("CityJSON", "CityJSONFeature"):
        raise ValueError("not CityJSON")
    found: dict[str, list] = {}
    for o in v["CityObjects"].values():
        row = found.setdefault(o["type"], [0, 0, {}])
        row[0] += 1
        for g in many(o.get("geometry")):
            row[1] += 1
            lod = str(g.get("lod", "other"))[:1]
            lod = lod if lod in "01234" else "other"
            row[2][lod] = row[2].get(lod, 0) + 1
    for kind in sorted(found):
        n, g, lods = found[kind]
        yield kind, n, g, joined(f"LoD{k}={lods[k]}" if k != "other" else f"other={lods[k]}" for k in sorted(lods))


def _of(f):
    return lambda data: f(loads(data))


def _either(f, whole: bool = False):
    """JSON, or YAML by its one or several documents."""

    def rows(data: bytes) -> Iterator[tuple]:
        from .texts import yaml_values

        docs = [loads(data)] if data.lstrip()[:1] in (b"{", b"[") else yaml_values(text(data))
        yield from f(docs if whole else docs[0])

    return rows


def _starts(*words: bytes):
    return lambda h: h.lstrip()[:1] == b"{" and all(w in h for w in words)


FORMATS = {
    "sarif": Format(("tool", "rule", "err", "warn", "note_oth", "n"), _of(sarif), (".sarif", ".sarif.json"), _starts(b'"runs"', b'"tool"')),
    "har": Format(("method", "url", "status_mime", "req_resp_bytes", "time_ms"), _of(har), (".har",), _starts(b'"log"', b'"entries"')),
    "cyclonedx": Format(("type", "name", "version", "scope"), _of(cyclonedx), (".cdx.json", ".bom.json"), _starts(b'"CycloneDX"')),
    "spdx": Format(("kind", "spdx_id", "name", "version"), _of(spdx), (".spdx.json",), _starts(b'"spdxVersion"')),
    "terraform-plan": Format(("address", "type", "actions", "module", "reason"), _of(terraform), (".tfplan.json",), _starts(b'"terraform_version"')),
    "otlp-json": Format(("sig", "svc", "scope", "n", "structure"), _of(otlp), (".otlp.json",), lambda h: any(k in h for k in (b'"resourceSpans"', b'"resourceMetrics"', b'"resourceLogs"'))),
    "cloudevents": Format(("type", "id", "context"), _of(cloudevents), (".cloudevent.json", ".cloudevents.json"), _starts(b'"specversion"')),
    "stix-json": Format(("type", "id", "created_modified", "labels", "structure"), _of(stix), (".stix", ".stix.json"), _starts(b'"bundle"', b'"objects"')),
    "taxii-json": Format(("kind", "id_title", "version_count", "detail"), _of(taxii), (".taxii", ".taxii.json")),
    "openapi": Format(("endpoint", "operation", "summary", "responses"), _either(openapi), (".openapi.json", ".openapi.yaml", ".swagger.json", ".swagger.yaml"), lambda h: b'"openapi"' in h or b'"swagger"' in h or h.startswith((b"openapi:", b"swagger:"))),
    "asyncapi": Format(("channel", "action_operation", "summary", "msgs"), _either(asyncapi), (".asyncapi.json", ".asyncapi.yaml"), lambda h: b'"asyncapi"' in h or h.startswith(b"asyncapi:")),
    "postman": Format(("folder_request", "method", "url", "status_responses", "auth_scripts"), _of(postman), (".postman_collection.json",), _starts(b'"info"', b"schema.getpostman.com")),
    "avro": Format(("path", "kind", "type_detail"), _of(avro), (".avsc", ".avpr")),
    "csl-json": Format(("id", "type", "title", "author", "yr"), _of(csl), (".csl.json", ".csl-json")),
    "fhir-json": Format(("resource", "id", "status_type", "profiles", "structure"), _of(fhir), (".fhir.json",), _starts(b'"resourceType"')),
    "iiif": Format(("kind", "no", "label", "detail"), _of(iiif), (".iiif.json", ".iiif"), _starts(b"iiif.io/api/presentation")),
    "json-api": Format(("kind", "type_id", "status", "attrs", "relationships"), _of(json_api), (".jsonapi", ".jsonapi.json")),
    "jsonfeed": Format(("id", "title", "content", "date", "author", "att"), _of(jsonfeed), (".jsonfeed", ".feed.json"), _starts(b"jsonfeed.org/version")),
    "jsonld": Format(("subject", "predicate", "object"), _of(jsonld), (".jsonld",), lambda h: b'"@context"' in h),
    "jsonmergepatch": Format(("path", "action", "value_type", "depth"), _of(merge_patch), (".merge-patch.json", ".mergepatch")),
    "jsonpatch": Format(("no", "op", "path", "from", "value_type"), _of(json_patch), (".json-patch", ".jsonpatch", ".patch.json")),
    "jsonschema": Format(("path", "details"), _of(json_schema), (".schema.json", ".jsonschema"), lambda h: b"json-schema.org" in h),
    "ocel-json": Format(("kind", "id_name", "type", "time_attrs", "relations"), _of(ocel), (".jsonocel", ".ocel.json"), _starts(b'"eventTypes"')),
    "openlabel": Format(("collection", "n", "content"), _of(openlabel), (".openlabel.json",), _starts(b'"openlabel"')),
    "kubernetes": Format(("resource", "api_version", "spec_shape", "status_secret", "doc"), _either(kubernetes, True), (".k8s.yaml", ".k8s.yml", ".k8s.json"), lambda h: bool(re.search(rb"(?m)^apiVersion:|\"apiVersion\"", h) and b"kind" in h)),
    "compose": Format(("service", "image_build", "ports", "depends", "volumes", "net_sec_cmd"), _either(compose), ("compose.yaml", "compose.yml", "docker-compose.yaml", "docker-compose.yml", ".compose.json")),
    "github-actions": Format(("job", "runner", "flow", "execution"), _either(actions), (".workflow.yml", ".workflow.yaml")),
    "jupyter": Format(("kind", "cell", "text"), _of(jupyter), (".ipynb",), _starts(b'"nbformat"')),
    "chart": Format(("chart", "series", "label", "value"), _of(chart), (".chart.json",)),
    "excalidraw": Format(("id", "type", "x", "y", "width", "height", "text", "source", "target"), _of(excalidraw), (".excalidraw",), _starts(b'"excalidraw"')),
    "cityjson": Format(("kind", "objects", "geometry", "lod_breakdown"), _of(cityjson), (".city.json", ".cityjson"), _starts(b'"CityJSON"')),
    "jsonseq": Format(("record", "leaf", "kind", "value"), records, (".jsonl", ".ndjson", ".jsons", ".json-seq", ".jsonseq"), lambda h: h.startswith(b"\x1e")),
    "json": Format(("leaf", "kind", "value"), _of(leaves), (".json",), lambda h: h.lstrip()[:1] in (b"{", b"[")),
}
