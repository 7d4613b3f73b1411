"""A query for each format: a file of the format for every row of a table, read by its reader.

``CASES`` has, by format, a file with ``<<column>>`` where the row's values go (a mapping
makes a ZIP package of such parts) and the rows that reading it must give.  From that
come the query, which writes the files' bytes and extracts them, and its SQL.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.rollups import read
from .files import extract, formats
from .formats.counts import KINDS

N, K, V = "<<s_name>>", "<<s_suppkey>>", "<<s_nationkey>>"
_ODF = 'xmlns:office="urn:o" xmlns:text="urn:t" xmlns:table="urn:tb" xmlns:draw="urn:d"'
_OFFICE = '<Relationships xmlns="http://r"><Relationship Id="rId1" Type="http://x/officeDocument" Target="{}"/></Relationships>'

CASES: dict[str, tuple] = {
    # delimited and configuration
    "csv": (f'key,name,note\r\n{K},{N},"say ""hi"", {V}"\r\n\r\n{K},x\r\n', [("1", "1", "key", K), ("1", "2", "name", N), ("1", "3", "note", f'say "hi", {V}'), ("2", "1", "key", K), ("2", "2", "name", "x"), ("2", "3", "note", "")]),
    "dif": (f'TABLE\n0,1\n""\nDATA\n0,0\n""\n-1,0\nBOT\n0,{K}\nV\n1,0\n"{N}"\n-1,0\nEOD\n', [("1", "1", "number", K), ("1", "2", "text", N)]),
    "sylk": (f'ID;PX\nC;Y1;X1;K{K}\nC;X2;K"{N}"\nC;Y2;X1;K3;ER1C1+1\nE\n', [("1", "1", K, None), ("1", "2", N, None), ("2", "1", "3", "R1C1+1")]),
    "properties": (f"# note\na.b = {N}\nk: {K}\na.b=la\\\n  st {V}\n", [("a.b", f"last {V}"), ("k", K)]),
    "toml": (f'k = {K}\n[t]\nname = "{N}"\nlist = [1, {V}]\n', [("$.k", "number", K), ("$.t.name", "string", N), ("$.t.list[0]", "number", "1"), ("$.t.list[1]", "number", V)]),
    "yaml": (f"# note\nkey: {K}\nname: '{N}'\nitems:\n  - a: 1\n    b: x y\n  - [2, {V}]\ntext: |\n  one\n  two\nempty: {{}}\n", [("$.key", "number", K), ("$.name", "string", N), ("$.items[0].a", "number", "1"), ("$.items[0].b", "string", "x y"), ("$.items[1][0]", "number", "2"), ("$.items[1][1]", "number", V), ("$.text", "string", "one\ntwo\n"), ("$.empty", "object", "{}")]),
    # documents
    "html": (f"<html><head><title>t</title><style>x</style></head><body><h1>{N}</h1>loose<p>a &amp; <b>b</b><ol start=3><li>one<ul><li>in</ul><li>two</ol><table><tr><th>k<td>{K}</table><pre>x  y\n z</pre><hr></body></html>", [("heading", "1", N), ("paragraph", "0", "loose"), ("paragraph", "0", "a & b"), ("item", "1", "3. one"), ("item", "2", "in"), ("item", "1", "4. two"), ("row", "2", f"k\t{K}"), ("code", "0", "x  y\n z"), ("rule", "0", "")]),
    "markdown": (f"# {N} #\n\npara *with* [link](u) and\n`code`\n\n- a\n  1. b\n\n> q\n\n| k | v\\|w |\n|---|:-:|\n| {K} | `a|b` |\n\n```py\nx = 1\n```\nTitle\n=====\n***\n", [("heading", "1", N), ("paragraph", "0", "para with link and code"), ("item", "1", "a"), ("item", "2", "1. b"), ("quote", "0", "q"), ("row", "2", "k\tv|w"), ("row", "2", f"{K}\ta|b"), ("code", "0", "x = 1"), ("heading", "1", "Title"), ("rule", "0", "")]),
    "quarto": (f"---\ntitle: {N}\n---\n## h\n```{{r}}\nx\n```\n", [("meta", "0", f"title: {N}"), ("heading", "2", "h"), ("code", "0", "x")]),
    "org": (f"* {N}\ntext one\ntwo\n- item {K}\n#+BEGIN_SRC c\nint x;\n#+END_SRC\n| a | {V} |\n", [("heading", "1", N), ("paragraph", "0", "text one two"), ("item", "1", f"item {K}"), ("code", "0", "int x;"), ("row", "2", f"a\t{V}")]),
    "asciidoc": (f"= {N}\n\npara\n\n* item {K}\n\n----\ncode\n----\n", [("heading", "1", N), ("paragraph", "0", "para"), ("item", "1", f"item {K}"), ("code", "0", "code")]),
    "rst": (f"Top {K}\n==========\n\npara {V}::\n\n  code\n\nSub\n---\n\n* item\n", [("heading", "1", f"Top {K}"), ("paragraph", "0", f"para {V}:"), ("code", "0", "code"), ("heading", "2", "Sub"), ("item", "1", "item")]),
    "rtf": (f"{{\\rtf1\\ansi{{\\fonttbl{{\\f0 Arial;}}}}\\f0 {N} \\b bold\\b0 .\\par caf\\'e9 {K}\\par}}", [("paragraph", "0", f"{N} bold."), ("paragraph", "0", f"café {K}")]),
    "srt": (f"1\n00:00:01,500 --> 00:00:03,000\n<i>{N}</i>\nline\n\n2\n00:01:00,000 --> 00:01:01,250\n{K}\n", [("1.5", "3", f"{N}\nline"), ("60", "61.25", K)]),
    "vtt": (f"WEBVTT\n\n00:01.500 --> 00:03.000\n{N}\n", [("1.5", "3", N)]),
    "ical": (f"BEGIN:VCALENDAR\r\nVERSION:2.0\r\nBEGIN:VEVENT\r\nUID:{K}\r\nSUMMARY:{N}\\, lo\r\n ng\r\nDTSTART;TZID=x:20200101T100000\r\nRRULE:FREQ=DAILY\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n", [("VEVENT", K, f"{N}, long", "20200101T100000", None, None, "true")]),
    "vcalendar": (f"BEGIN:VCALENDAR\nVERSION:1.0\nBEGIN:VTODO\nSUMMARY:{N}\nDUE:20200101\nEND:VTODO\nEND:VCALENDAR\n", [("VTODO", None, N, None, "20200101", None, "false")]),
    "vcard": (f"BEGIN:VCARD\nVERSION:3.0\nN:Last;{N};;;\nFN:{N} Last\nTEL;TYPE=work:1\nTEL:{K}\nEND:VCARD\n", [(f"{N} Last", f"Last {N}", None, None, None, f"1; {K}", None)]),
    "po": (f'#, fuzzy\nmsgctxt "c"\nmsgid "a{K}"\n"b\\n"\nmsgstr "{N}"\n', [("c", f"a{K}b\n", N, "fuzzy")]),
    "eml": (f"From: a@x.org\r\nTo: b@y.org\r\nDate: Wed, 01 Jan 2020 10:00:00 +0000\r\nSubject: =?utf-8?q?caf=C3=A9?= {K}\r\n\r\nBody {N}\r\n", [("a@x.org", "b@y.org", "Wed, 01 Jan 2020 10:00:00 +0000", f"café {K}", f"Body {N}", "")]),
    "mbox": (f"From a 2020\nFrom: a@x.org\nSubject: 1\n\n>From {N}\n\nFrom b 2020\nFrom: b@x.org\nSubject: {K}\n\ntwo\n", [("a@x.org", None, None, "1", f"From {N}", ""), ("b@x.org", None, None, K, "two", "")]),
    "mhtml": (f"MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=b\r\n\r\n--b\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>{N}</p>\r\n--b\r\nContent-Type: image/png\r\n\r\nx\r\n--b--\r\n", [("paragraph", "0", N)]),
    # JSON
    "json": (f'{{"a": {{"b c": [1, {{}}, "{N}"], "t": true}}, "n": null, "k": {K}, "f": 1.5}}', [('$.a["b c"][0]', "number", "1"), ('$.a["b c"][1]', "object", "{}"), ('$.a["b c"][2]', "string", N), ("$.a.t", "boolean", "true"), ("$.n", "null", None), ("$.k", "number", K), ("$.f", "number", "1.5")]),
    "jsonseq": (f'{{"k": {K}}}\n\nnot json\n["{N}"]\n', [("0", "$.k", "number", K), ("1", None, "invalid", None), ("2", "$[0]", "string", N)]),
    "sarif": (f'{{"runs":[{{"tool":{{"driver":{{"name":"T","rules":[{{"id":"r{V}","defaultConfiguration":{{"level":"error"}}}}]}}}},"results":[{{"ruleIndex":0}},{{"ruleId":"x{K}","level":"note"}},{{"ruleId":"x{K}"}}]}}]}}', [("T", f"r{V}", "1", "0", "0", "1"), ("T", f"x{K}", "0", "1", "1", "2")]),
    "har": (f'{{"log":{{"entries":[{{"time":12,"request":{{"method":"GET","url":"http://h/{K}?api_key=s&q={V}","bodySize":0}},"response":{{"status":200,"bodySize":9,"content":{{"mimeType":"text/html"}}}}}}]}}}}', [("GET", f"http://h/{K}?api_key=***&q={V}", "200 text/html", "0 / 9", "12"), ("total", None, None, None, "12")]),
    "cyclonedx": (f'{{"bomFormat":"CycloneDX","components":[{{"type":"library","group":"g","name":"{N}","version":"{V}","components":[{{"type":"file","name":"f{K}"}}]}}]}}', [("library", f"g/{N}", V, None), ("file", f"f{K}", None, None)]),
    "spdx": (f'{{"spdxVersion":"SPDX-2.3","SPDXID":"D","name":"{N}","packages":[{{"SPDXID":"P{K}","name":"p","versionInfo":"{V}"}}],"relationships":[{{"spdxElementId":"D","relationshipType":"DESCRIBES","relatedSpdxElement":"P{K}"}}]}}', [("document", "D", N, "SPDX-2.3"), ("package", f"P{K}", "p", V), ("relationship", "D", "DESCRIBES", f"P{K}")]),
    "terraform-plan": (f'{{"terraform_version":"1","resource_changes":[{{"address":"a.b[{K}]","type":"a","module_address":"m{V}","change":{{"actions":["delete","create"]}},"action_reason":"r"}}]}}', [(f"a.b[{K}]", "a", "delete, create", f"m{V}", "r")]),
    "otlp-json": (f'{{"resourceSpans":[{{"resource":{{"attributes":[{{"key":"service.name","value":{{"stringValue":"{N}"}}}}]}},"scopeSpans":[{{"scope":{{"name":"s{V}"}},"spans":[{{"name":"a"}},{{"name":"b","kind":1}}]}}]}}]}}', [("span", N, f"s{V}", "2", "kind, name")]),
    "cloudevents": (f'{{"specversion":"1.0","type":"t.{V}","id":"{K}","source":"http://s","time":"2020","data":{{"a":1}}}}', [(f"t.{V}", K, "[uri] · 2020 · object")]),
    "stix-json": (f'{{"type":"bundle","objects":[{{"type":"malware","id":"m--{K}","created":"1","modified":"2","labels":["a","b"],"name":"{N}"}}]}}', [("malware", f"m--{K}", "1 / 2", "a, b", "name")]),
    "taxii-json": (f'{{"collections":[{{"id":"{K}","title":"{N}","media_types":["a","b"]}}]}}', [("collection", K, "2", N)]),
    "openapi": (f'{{"openapi":"3.0.0","paths":{{"/p/{K}":{{"get":{{"operationId":"g","summary":"{N}","responses":{{"200":{{}},"404":{{}}}}}}}}}}}}', [(f"GET /p/{K}", "g", N, "200, 404")]),
    "asyncapi": (f'{{"asyncapi":"2.0.0","channels":{{"c{K}":{{"publish":{{"operationId":"o","summary":"{N}","message":{{}}}}}}}}}}', [(f"c{K}", "publish / o", N, "1")]),
    "postman": (f'{{"info":{{"name":"x"}},"item":[{{"name":"f","item":[{{"name":"{N}","request":{{"method":"POST","url":{{"raw":"http://h/{K}?token=1"}},"auth":{{"type":"bearer"}}}},"response":[{{}}]}}]}}]}}', [("f", None, None, "1 items", None), (f"f / {N}", "POST", f"http://h/{K}?token=***", "1", "bearer")]),
    "avro": (f'{{"type":"record","name":"r{K}","fields":[{{"name":"a","type":"long"}},{{"name":"u","type":["null","string"]}},{{"name":"e","type":{{"type":"enum","name":"c","symbols":["X","Y"]}}}}]}}', [(f"r{K}", "record", "3 fields"), (f"r{K}.a", "field", "long"), (f"r{K}.u", "union", "null, string"), (f"r{K}.e.c", "enum", "X, Y")]),
    "csl-json": (f'[{{"id":"{K}","type":"book","title":"{N}","author":[{{"family":"F","given":"G"}},{{"literal":"L"}}],"issued":{{"date-parts":[[2001,2]]}}}}]', [(K, "book", N, "F, G; L", "2001")]),
    "fhir-json": (f'{{"resourceType":"Bundle","id":"b","type":"collection","entry":[{{"resource":{{"resourceType":"Patient","id":"{K}","meta":{{"profile":["p"]}},"active":true}}}}]}}', [("Bundle", "b", "collection", "0", "entry, type"), ("Patient", K, None, "1", "active")]),
    "iiif": (f'{{"type":"Manifest","label":{{"en":["{N}"]}},"items":[{{"label":{{"en":["c"]}},"width":3,"height":4}}],"metadata":[{{"label":"k","value":"{K}"}}]}}', [("manifest", None, N, "Manifest"), ("canvas", "1", "c", "3x4"), ("metadata", None, "k", K)]),
    "json-api": (f'{{"data":[{{"type":"a","id":"{K}","attributes":{{"y":1,"x":2}},"relationships":{{"r":{{}}}}}}],"errors":[{{"id":"e","status":"404","title":"{N}"}}]}}', [("data", f"a / {K}", None, "x, y", "r"), ("error", "e", "404", N, None)]),
    "jsonfeed": (f'{{"version":"https://jsonfeed.org/version/1.1","items":[{{"id":"{K}","title":"{N}","content_html":"<p>c</p>","date_published":"2020","authors":[{{"name":"a"}}],"attachments":[{{}}]}}]}}', [(K, N, "c", "2020", "a", "1")]),
    "jsonld": (f'{{"@context":"c","@graph":[{{"@id":"s{K}","name":"{N}","knows":{{"@id":"o","age":{V}}}}}]}}', [(f"s{K}", "name", N), (f"s{K}", "knows", "o"), ("o", "age", V)]),
    "jsonmergepatch": (f'{{"a":null,"b":{{"c/d":{K}}},"e":"{N}"}}', [("/a", "remove", "null", "1"), ("/b", "merge", "object", "1"), ("/b/c~1d", "set", "number", "2"), ("/e", "set", "string", "1")]),
    "jsonpatch": (f'[{{"op":"add","path":"/{K}","value":"{N}"}},{{"op":"move","path":"/a","from":"/b"}}]', [("1", "add", f"/{K}", None, "string"), ("2", "move", "/a", "/b", None)]),
    "jsonschema": (f'{{"type":"object","required":["k{K}"],"properties":{{"k{K}":{{"type":["string","null"],"enum":["{N}","b"]}},"l":{{"type":"array","items":{{"$ref":"#/x"}}}}}}}}', [("#", f"object; required(k{K})"), (f"#/properties/k{K}", "string|null; enum(2)"), ("#/properties/l", "array"), ("#/properties/l/items", "#/x")]),
    "ocel-json": (f'{{"eventTypes":[{{"name":"et","attributes":[{{}}]}}],"objectTypes":[{{"name":"ot"}}],"events":[{{"id":"e{K}","type":"et","time":"2020","relationships":[{{}},{{}}]}}],"objects":[{{"id":"{N}","type":"ot"}}]}}', [("event type", "et", None, "1", None), ("object type", "ot", None, "0", None), ("event", f"e{K}", "et", "2020", "2"), ("object", N, "ot", "0", "0")]),
    "openlabel": (f'{{"openlabel":{{"metadata":{{"schema_version":"1"}},"objects":{{"1":{{"type":"car"}},"{K}x":{{"type":"bus"}}}}}}}}', [("metadata", "1", ""), ("objects", "2", "bus, car")]),
    "kubernetes": (f"apiVersion: v1\nkind: Pod\nmetadata:\n  name: p{K}\nspec:\n  containers:\n  - name: c\n    image: {N}\n  nodeName: n\n---\napiVersion: v1\nkind: Secret\nmetadata: {{name: s}}\ndata:\n  a: eA==\n", [(f"Pod/p{K}", "v1", "containers, nodeName", "", "1"), ("Secret/s", "v1", "", "1 secret values omitted", "2")]),
    "compose": (f"services:\n  web{K}:\n    image: {N}\n    ports:\n      - \"80:80\"\n    depends_on: [db]\n    privileged: true\n  db:\n    build: ./db\n    volumes:\n      - d:/x\n", [(f"web{K}", N, "80:80", "db", "", "privileged"), ("db", "./db", "", "", "d:/x", "")]),
    "github-actions": (f"on: push\njobs:\n  j{K}:\n    runs-on: ubuntu\n    needs: [a, b]\n    steps:\n      - uses: x/y@v{V}\n      - run: make\n", [(f"j{K}", "ubuntu", "needs a, b", f"2 steps: x/y@v{V}")]),
    "jupyter": (f'{{"nbformat":4,"cells":[{{"cell_type":"markdown","source":["# {N}\\n","x"]}},{{"cell_type":"code","source":"1+{K}","outputs":[{{"output_type":"stream","text":"o"}},{{"output_type":"execute_result","data":{{"text/plain":["{V}"]}}}},{{"output_type":"error","ename":"E","evalue":"v"}}]}}]}}', [("markdown", "1", f"# {N}\nx"), ("code", "2", f"1+{K}"), ("output", "2", "o"), ("output", "2", V), ("output", "2", "E: v")]),
    "chart": (f'{{"type":"bar","labels":["a","{N}"],"datasets":[{{"label":"s{V}","data":[1,{K}]}}]}}', [("bar", f"s{V}", "a", "1"), ("bar", f"s{V}", N, K)]),
    "excalidraw": (f'{{"type":"excalidraw","elements":[{{"id":"{K}","type":"text","x":1,"y":2,"width":3,"height":4,"text":"{N}"}},{{"id":"d","isDeleted":true}},{{"id":"l","type":"arrow","x":0,"y":0,"width":1,"height":1,"startBinding":{{"elementId":"{K}"}}}}]}}', [(K, "text", "1", "2", "3", "4", N, None, None), ("l", "arrow", "0", "0", "1", "1", None, K, None)]),
    "cityjson": (f'{{"type":"CityJSON","CityObjects":{{"a{K}":{{"type":"Building","geometry":[{{"lod":"2.1"}},{{"lod":1}}]}},"b":{{"type":"Building"}},"c":{{"type":"Road"}}}}}}', [("Building", "2", "2", "LoD1=1, LoD2=1"), ("Road", "1", "0", "")]),
    # XML with rows of its own
    "xml": (f'<a k="{K}"><b>t <c/>u</b><d xmlns="n">{N}</d></a>', [("/a", "0", f'k="{K}"', ""), ("/a/b", "1", "", "t"), ("/a/b/c", "2", "", ""), ("/a/d", "1", "", N)]),
    "junit": (f'<testsuites><testsuite name="{N}" time="1.5"><testcase/><testcase><failure/><error/></testcase><testcase><skipped/></testcase></testsuite><testsuite name="b"><testcase><error/></testcase></testsuite></testsuites>', [(N, "3", "1", "1", "0 / 1", "1.5"), ("b", "1", "0", "0", "1 / 0", "0"), ("(total)", "4", "1", "1", "1 / 1", "1.5")]),
    "coverage": (f'<report><package name="p{K}"><counter type="LINE" missed="1" covered="3"/><counter type="CLASS" missed="0" covered="2"/></package></report>', [(f"p{K}", "2", "3 / 1", "0 / 0", "0 / 0", "75.0%")]),
    "feed": (f'<rss version="2.0"><channel><item><title>{N}</title><pubDate>d{K}</pubDate><category>c</category></item></channel></rss>', [("1", N, f"d{K}", "category")]),
    "opml": (f'<opml version="2.0"><body><outline text="{N}"><outline text="f{K}" type="rss" xmlUrl="http://x"/></outline></body></opml>', [(N, None, "0", "group"), (f"f{K}", "rss", "1", "feed")]),
    "plist": (f'<plist version="1.0"><dict><key>k</key><integer>{K}</integer><key>l</key><array><string>{N}</string><true/></array></dict></plist>', [("", "dict", None, "2"), ("/k", "integer", K, None), ("/l", "array", None, "2"), ("/l/0", "string", N, None), ("/l/1", "true", "true", None)]),
    "marcxml": (f'<record xmlns="http://www.loc.gov/MARC21/slim"><leader>l</leader><controlfield tag="001">{K}</controlfield><datafield tag="245"><subfield code="a">{N}</subfield><subfield code="u">http://x</subfield></datafield></record>', [("1", "LDR", None, "l"), ("1", "001", None, K), ("1", "245", "a", N), ("1", "245", "u", "[uri]")]),
    "mods": (f"<mods><titleInfo><title>{N}</title></titleInfo><identifier type=\"local\">{K}</identifier></mods>", [("1", "titleInfo", None, N), ("1", "identifier", "local", K)]),
    "mets": (f'<mets><metsHdr ID="h"/><fileSec><fileGrp USE="u"><file ID="f{K}" MIMETYPE="image/png" SIZE="{V}"/></fileGrp></fileSec><structMap TYPE="t"><div LABEL="{N}"/></structMap></mets>', [("metsHdr", "h", None, "0"), ("fileGrp", "u", None, "1"), ("file", f"f{K}", "image/png", V), ("structMap", "t", None, "1"), ("div", N, N, "0")]),
    "premis": (f'<premis><object type="file"><objectIdentifier><objectIdentifierValue>{K}</objectIdentifierValue></objectIdentifier><originalName>{N}</originalName></object></premis>', [("object", "file", "objectIdentifierValue", K), ("object", "file", "originalName", N)]),
    "ead": (f'<ead><archdesc level="fonds"><did><unittitle>{N}</unittitle><unitid>{K}</unitid></did><dsc><c01 level="series"><did><unittitle>s</unittitle><unitdate>{V}</unitdate></did></c01></dsc></archdesc></ead>', [("archdesc", "fonds", N, K), ("c01", "series", "s", V)]),
    "eac-cpf": (f'<eac-cpf><cpfDescription><identity><entityType>person</entityType><nameEntry><part>{N}</part><part>{K}</part></nameEntry></identity><relations><cpfRelation cpfRelationType="family"><relationEntry>x{V}</relationEntry></cpfRelation></relations></cpfDescription></eac-cpf>', [("name", None, f"{N} {K}", None), ("entityType", None, "1", "person"), ("cpfRelation", "family", f"x{V}", None)]),
    "dublin-core": (f'<metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{N}</dc:title><dc:identifier>http://x/{K}</dc:identifier></metadata>', [("1", "title", N), ("1", "identifier", "[uri]")]),
    "alto": (f'<alto><Layout><Page PHYSICAL_IMG_NR="{K}"><TextLine><String CONTENT="{N}" WC="0.5"/><String CONTENT="b" WC="1.0"/></TextLine></Page></Layout></alto>', [("page", K, None, None), ("line", K, f"{N} b", "0.75")]),
    "tei": (f'<TEI><text><body><head>{N}</head><p n="{K}">a <hi>b</hi></p></body></text></TEI>', [("head", "3", N, None), ("p", "3", "a b", K)]),
    "s1000d": (f'<dmodule><content><techName>{N}</techName><para id="i{K}">t</para></content></dmodule>', [("techName", "2", N, None), ("para", "2", "t", f"i{K}")]),
    "rdf-xml": (f'<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><Thing r:about="s{K}"><name>{N}</name><knows r:resource="o{V}"/></Thing></r:RDF>', [("type", "Thing", f"s{K}"), ("name", N, f"s{K}"), ("knows", f"o{V}", f"s{K}")]),
    "reqif": (f'<REQ-IF><SPEC-OBJECT-TYPE IDENTIFIER="t" LONG-NAME="Req"/><SPEC-OBJECTS><SPEC-OBJECT IDENTIFIER="o{K}"><TYPE><SPEC-OBJECT-TYPE-REF>t</SPEC-OBJECT-TYPE-REF></TYPE><VALUES><ATTRIBUTE-VALUE-STRING THE-VALUE="{N}"/></VALUES></SPEC-OBJECT></SPEC-OBJECTS><SPECIFICATION><CHILDREN><SPEC-HIERARCHY><OBJECT><SPEC-OBJECT-REF>o{K}</SPEC-OBJECT-REF></OBJECT></SPEC-HIERARCHY></CHILDREN></SPECIFICATION></REQ-IF>', [("1", f"o{K}", N, "Req")]),
    "spreadsheetml": (f'<Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet"><Worksheet ss:Name="s"><Table><Row ss:Index="2"><Cell><Data ss:Type="Number">{K}</Data></Cell><Cell ss:Index="3" ss:Formula="=A2"><Data ss:Type="String">{N}</Data></Cell></Row></Table></Worksheet></Workbook>', [("s", "A2", "Number", K, None), ("s", "C2", "String", N, "=A2")]),
    "wsdl": (f'<definitions xmlns="http://schemas.xmlsoap.org/wsdl/"><message name="m{K}"><part name="p"/></message><portType name="{N}"><operation name="a"/><operation name="b"/></portType></definitions>', [("message", f"m{K}", "1", "p"), ("portType", N, "2", "a, b")]),
    "xbrl": (f'<xbrl xmlns:g="u"><context id="c"><period><startDate>a</startDate><endDate>b</endDate></period></context><unit id="u"><measure>EUR</measure></unit><g:Cash contextRef="c" unitRef="u">{K}</g:Cash><g:Name contextRef="z">{N}</g:Name></xbrl>', [("Cash", K, "a..b / EUR"), ("Name", N, "[context omitted] / -")]),
    "xfdf": (f'<xfdf><fields><field name="a"><field name="b"><value>{N}</value></field><field name="pass_word"><value>{K}</value></field></field></fields><annots><text page="{V}" name="n"><contents>c</contents></text></annots></xfdf>', [("a.b", "field", N, None), ("a.pass_word", "field", "***", None), ("n", "annotation", "c", f"text page {V}")]),
    "xmi": (f'<XMI><Model id="m{K}" name="{N}"><e id="c" type="Class" name="x"/></Model></XMI>', [("1", f"m{K}", "Model", N), ("2", "c", "Class", "x")]),
    "xliff": (f'<xliff><file original="f{V}"><body><trans-unit id="{K}"><source>s</source><target state="final">{N}</target></trans-unit></body></file></xliff>', [(f"f{V}", K, "s", N, "final")]),
    "ttml": (f'<tt><body><div><p begin="00:00:01.5" end="3s">{N}</p><p begin="1s" dur="500ms">{K}</p></div></body></tt>', [("1.5", "3", N), ("1", "1.5", K)]),
    "docbook": (f"<article><title>{N}</title><section><title>s{K}</title><para>p</para><itemizedlist><listitem><para>i</para></listitem></itemizedlist><programlisting>x</programlisting></section></article>", [("heading", "1", N), ("heading", "2", f"s{K}"), ("paragraph", "0", "p"), ("item", "1", "i"), ("code", "0", "x")]),
    "dita": (f"<topic><title>{N}</title><body><p>p{K}</p><ul><li>i</li></ul></body></topic>", [("heading", "1", N), ("paragraph", "0", f"p{K}"), ("item", "1", "i")]),
    "jats": (f"<article><front><journal-meta><x>no</x></journal-meta><article-meta><article-title>{N}</article-title></article-meta></front><body><sec><title>s{K}</title><p>p</p></sec></body></article>", [("heading", "1", N), ("heading", "2", f"s{K}"), ("paragraph", "0", "p")]),
    "fb2": (f"<FictionBook><description><book-title>{N}</book-title></description><body><section><title>t</title><p>p{K}</p></section></body><binary>xx</binary></FictionBook>", [("heading", "1", N), ("heading", "2", "t"), ("paragraph", "0", f"p{K}")]),
    "dmn": (f'<definitions><decision name="{N}"><decisionTable><input label="a"/><output name="o"/><rule><inputEntry><text>&gt; {K}</text></inputEntry><outputEntry><text>1</text></outputEntry></rule></decisionTable></decision></definitions>', [("decision", "1", N), ("row", "2", "a\to"), ("row", "2", f"> {K}\t1")]),
    "cyclonedx-xml": (f'<bom xmlns="http://cyclonedx.org/schema/bom/1.4"><components><component type="library"><group>g</group><name>{N}</name><version>{V}</version></component></components></bom>', [("library", f"g/{N}", V, None)]),
    "projectxml": (f"<Project><Tasks><Task><UID>{K}</UID><Name>{N}</Name><Start>s</Start><Finish>f</Finish><PercentComplete>{V}</PercentComplete><Milestone>1</Milestone><PredecessorLink><PredecessorUID>7</PredecessorUID></PredecessorLink></Task></Tasks></Project>", [("0", K, N, "s", "f", V, "false", "true", "7")]),
    "bpmn": (f'<definitions xmlns="http://www.omg.org/spec/BPMN/20100524/MODEL" xmlns:di="http://www.omg.org/spec/BPMN/20100524/DI"><process><task id="t{K}" name="{N}"/><task id="hidden"/></process><di:BPMNDiagram><di:BPMNShape bpmnElement="t{K}"><Bounds x="1" y="2" width="3" height="{V}"/></di:BPMNShape></di:BPMNDiagram></definitions>', [(f"t{K}", "task", N, None, None, "1", "2", "3", V)]),
    "cmmn": (f'<definitions><case><humanTask id="h{K}" name="{N}"/></case><CMMNDI><CMMNShape cmmnElementRef="h{K}"><Bounds x="1" y="2" width="3" height="4"/></CMMNShape></CMMNDI></definitions>', [(f"h{K}", "humanTask", N, None, None, "1", "2", "3", "4")]),
    "flat-opc": (f'<package xmlns="http://schemas.microsoft.com/office/2006/xmlPackage"><part name="/w{K}" contentType="c"><xmlData><t>{N}</t><t>b</t></xmlData></part></package>', [(f"/w{K}", "c", f"{N} b")]),
    "visio": (f'<VisioDocument><Pages><Page Name="{N}"><Shapes><Shape ID="{K}" NameU="Box"><XForm><PinX>1</PinX><PinY>2</PinY></XForm><Text>t</Text></Shape></Shapes></Page></Pages></VisioDocument>', [(N, K, "Box", "t", "1", "2")]),
    "drawio": (f'<mxfile><diagram><mxGraphModel><root><mxCell id="0"/><mxCell id="n{K}" value="&lt;b&gt;{N}&lt;/b&gt;" vertex="1"><mxGeometry x="1" y="2" width="3" height="4"/></mxCell><mxCell id="e" edge="1" source="n{K}" target="n{K}"/></root></mxGraphModel></diagram></mxfile>', [("1", f"n{K}", "node", N, None, None, "1", "2", "3", "4"), ("1", "e", "edge", "", f"n{K}", f"n{K}", None, None, None, None)]),
    "svg": (f'<svg xmlns="http://www.w3.org/2000/svg"><g><rect x="{K}" y="1" width="2" height="3" fill="red"/></g><text x="0" y="0">{N}</text><path d="M0 0L1 1" stroke="#000"/></svg>', [("rect", "2", f"x={K} y=1 width=2 height=3", "red", None, None), ("text", "1", "x=0 y=0", None, None, N), ("path", "1", "M0 0L1 1", None, "#000", None)]),
    "openscenario": (f'<OpenSCENARIO><FileHeader revMajor="1" revMinor="{V}" description="{N}"/><Storyboard><Story name="s{K}"/></Storyboard></OpenSCENARIO>', [("FileHeader", f"1.{V}", "1", N), ("Story", f"s{K}", "1", None)]),
    # XML of which the structure is counted
    "sbml": (f'<sbml xmlns="u{V}"><model><listOfSpecies><species id="{K}"/><species/></listOfSpecies><reaction/></model></sbml>', [("Document", "sbml", f"u{V}"), ("Model", "1", "model=1"), ("Network", "3", "species=2 reaction=1"), ("Parameters", "0", ""), ("Extensions", "0", "")]),
    "cda": (f'<ClinicalDocument><section><text>{N}</text><entry><observation/></entry></section></ClinicalDocument>', [("Document", "ClinicalDocument", None), ("Clinical entries", "2", "entry=1 observation=1"), ("Care context", "0", ""), ("Narrative", "2", "section=1 text=1")]),
    "xsd": (f'<schema xmlns="http://www.w3.org/2001/XMLSchema"><element name="{N}"/><complexType><sequence><element/></sequence></complexType></schema>', [("Document", "schema", "http://www.w3.org/2001/XMLSchema"), ("Declarations", "3", "element=2 complexType=1"), ("Compositors", "1", "sequence=1"), ("Derivation", "0", ""), ("Dependencies", "0", "")]),
    "xslt": (f'<stylesheet><template match="{N}"><for-each/><variable/></template></stylesheet>', [("Document", "stylesheet", None), ("Stylesheet", "1", "template=1"), ("Control", "1", "for-each=1"), ("Bindings", "1", "variable=1"), ("Dependencies", "0", "")]),
    "iso19115": (f"<MD_Metadata><language>en</language><identificationInfo><title>{N}</title><EX_GeographicBoundingBox><westBoundLongitude>{K}</westBoundLongitude><eastBoundLongitude>2</eastBoundLongitude></EX_GeographicBoundingBox></identificationInfo><contact/></MD_Metadata>", [("Title", N, None), ("Language", "en", None), ("Geographic bounding box", f"{K}, 2", "westBoundLongitude, eastBoundLongitude"), ("Resource links", "0", None), ("Contacts", "1", None), ("Quality/constraints", "0", None)]),
    "ubl": (f'<Invoice xmlns="urn:oasis:names:specification:ubl:schema:xsd:Invoice-2"><UBLVersionID>2.1</UBLVersionID><IssueDate>d{K}</IssueDate><InvoiceLine/><InvoiceLine/><TaxTotal/></Invoice>', [("Document", "Invoice", "urn:oasis:names:specification:ubl:schema:xsd:Invoice-2"), ("UBL version", "2.1", None), ("Issue date", f"d{K}", None), ("Line items", "2", "InvoiceLine"), ("Parties", "0", None), ("Totals", "1", None), ("Payment structure", "0", None), ("Adjustments", "0", None), ("References/attachments", "0", None)]),
    "fhir-xml": (f'<Patient xmlns="http://hl7.org/fhir"><id value="{K}"/><extension/></Patient>', [("Root", "Patient", K), ("Type", "Patient", "1"), ("Bundle entries", "0", None), ("Extensions", "1", None)]),
    "citygml": (f'<CityModel><cityObjectMember><Building id="{K}"><lod2Solid/><lod1Solid/></Building></cityObjectMember><cityObjectMember><Road/></cityObjectMember></CityModel>', [("Building", "1", "2", "LoD1=1, LoD2=1"), ("Road", "1", "0", "")]),
    "mathml": (f"<math><mfrac><mi>x</mi><mrow><mn>{K}</mn><mo>+</mo><msqrt><mi>y</mi></msqrt></mrow></mfrac></math>", [("Formula", f"x/({K}+sqrt(y))", None), ("Element", "mfrac", "1"), ("Element", "mi", "2"), ("Element", "mn", "1"), ("Element", "mo", "1"), ("Element", "mrow", "1"), ("Element", "msqrt", "1")]),
    "xmp": (f'<x:xmpmeta xmlns:x="adobe:ns:meta/" x:xmptk="t"><r:RDF xmlns:r="http://r#"><r:Description xmlns:d="http://d#" d:k="{K}"><d:title><r:li>{N}</r:li><r:li>b</r:li></d:title></r:Description></r:RDF></x:xmpmeta>', [("Packet", "xmpmeta", "t"), ("Property", "k", K), ("Property", "title", f"{N}; b")]),
    # records
    "clustal": ("CLUSTAL W\n\ns1 ACGT-\ns2 AC-TT\n   ** *\n\ns1 GG\ns2 GA\n", [("s1", "7", "ACGT-GG"), ("s2", "7", "AC-TTGA")]),
    "stockholm": (f"# STOCKHOLM 1.0\n#=GF ID {N}\na ACG\nb A-G\n//\n", [("1", "a", "3", "ACG"), ("1", "b", "3", "A-G")]),
    "maf": (f"##maf version=1\na score={V}\ns h.c1 10 4 + 100{K} AC-GT\ns m.c1 0 3 - 50 A--GT\n", [("1", "h.c1", "10", "4", "+", f"100{K}", V, "AC-GT"), ("1", "m.c1", "0", "3", "-", "50", V, "A--GT")]),
    "genbank": (f"LOCUS       L{K}    9 bp    DNA     linear   SYN\nDEFINITION  {N}\n            more.\nACCESSION   A{K} B\nFEATURES             Location/Qualifiers\n     source          1..9\n     gene            1..3\nORIGIN\n        1 acgtacgta\n//\n", [("1", f"L{K}", "9", "DNA", "linear", f"A{K}", f"{N} more.", "2", "9", "acgtacgta")]),
    "embl": (f"ID   X{K}; SV 1; linear; DNA; STD; SYN; 6 BP.\nAC   X{K};\nDE   {N}\nFT   source          1..6\nSQ   Sequence 6 BP;\n     acgtac   6\n//\n", [("1", f"X{K}", "6", "DNA", "linear", f"X{K}", N, "1", "6", "acgtac")]),
    "uniprot": (f"ID   E{K}_HUMAN  Reviewed;  5 AA.\nAC   P{K};\nDE   RecName: Full={N};\nGN   Name=G1;\nOS   Homo sapiens.\nFT   CHAIN           1..5\nSQ   SEQUENCE   5 AA;\n     MKVLA\n//\n", [("1", f"E{K}_HUMAN", "Reviewed", f"P{K}", N, "G1", "Homo sapiens", "5", "1", "5", "MKVLA")]),
    "ris": (f"TY  - JOUR\nTI  - {N}\nAU  - A, B\nAU  - C\nPY  - 2001/02\nJO  - J\nSP  - 1\nEP  - {K}\nUR  - http://x\nER  - \n", [("1", "JOUR", N, "A, B; C", "2001", "J", f"1-{K}", "", "[uri]", "", "")]),
    "bib": (f"@article{{k{K},\n title = {{The {{{N}}} case}},\n author = \"A and B\", year = 2001,\n journal={{J}}\n}}\n@comment{{x}}\n", [("article", f"k{K}", f"The {N} case", "A and B", "2001", "J")]),
    "warc": (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://h/{K}?session=1\r\nWARC-Date: 2020\r\nContent-Length: 46\r\n\r\nHTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nok\r\n\r\n", [("response", f"http://h/{K}?session=***", "200", "text/html", "2020", "46")]),
    "turtle": (f'@prefix e: <http://e/> .\ne:s{K} a e:T ; e:name "{N}"@en , "x;.y" .\n<http://a> e:p [ e:q {V} ] .\n', [(f"e:s{K}", "rdf:type", "e:T"), (f"e:s{K}", "e:name", f'"{N}"@en'), (f"e:s{K}", "e:name", '"x;.y"'), ("<http://a>", "e:p", "_:b1"), ("_:b1", "e:q", V)]),
    "protobuf": (f'syntax = "proto3";\npackage p{V};\nmessage M{K} {{\n  repeated string a = 1; // n\n  map<string, int32> m = 2 [deprecated=true];\n  enum E {{ X = 0; }}\n}}\nservice S {{ rpc Get (A) returns (stream B); }}\n', [(None, "syntax", "proto3", None, None), (None, "package", f"p{V}", None, None), (None, "message", f"M{K}", None, None), (f"M{K}", "field", "a", "repeated string", "1"), (f"M{K}", "field", "m", "map<string,int32>", "2 [deprecated=true]"), (f"M{K}", "enum", "E", None, None), (f"M{K}.E", "value", "X", None, "0"), (None, "service", "S", None, None), ("S", "rpc", "Get", "A -> stream B", None)]),
    "graphql": (f'"doc" type T{K} implements I {{ a(x: Int): [String!]! b: ID }}\nenum E {{ X Y }}\nunion U = A | B\n', [(f"T{K}", "type", "a", "(x: Int): [String!]!"), (f"T{K}", "type", "b", "ID"), ("E", "enum", "X", None), ("E", "enum", "Y", None), ("U", "union", None, "A | B")]),
    "spice": (f"{N}\nR{K} a b 1k\nQ1 c b e\n+ 2N{V}\n* note\nX1 p q sub\n.tran 1n 2n\n", [(f"R{K}", "resistor", "a b", "1k", "2"), ("Q1", "bipolar transistor", "c b e", f"2N{V}", "3"), ("X1", "subcircuit", "p q", "sub", "6"), (".tran", "directive", None, "1n 2n", "7")]),
    "energyplus-idf": (f"! note\nZone, z{K}, 0;\nZone,\n  b; !- name\nVersion, 9;\n", [("Version", "1", "1 fields at most"), ("Zone", "2", "2 fields at most")]),
    "energyplus-epw": (f"LOCATION,{N},S,C,src,1,{K},2,3,4\na\nb\nc\nd\ne\nf\ng\n1990,1,1\n1990,1,2\n1991,1,1\n", [("Location", f"{N}, S, C", f"latitude {K}, longitude 2, elevation 4"), ("Records", "3", "2 years"), ("Year", "1990", "2"), ("Year", "1991", "1")]),
    "fds": (f"&HEAD CHID='{N}' /\n&SURF ID='s{K}', X=1/\n&SURF ID='a/b' /\n", [("HEAD", "1", ""), ("SURF", "2", f"s{K}, a/b")]),
    "openscad": ("use <lib.scad>\nmodule m(a, b=1) { cube(1); cube(2); }\n// sphere(1)\n", [("module", "m", "a, b=1"), ("use", "lib.scad", None), ("call", "cube", "2")]),
    "opencrg": (f"$ROAD_CRG ! c\nREFERENCE_LINE_END_U = {K}.0\nX = 1\n$\n$$$$\n1 2\n", [("ROAD_CRG", "2", f"REFERENCE_LINE_END_U = {K}.0; X = 1")]),
    "lcov": (f"TN:\nSF:/a/{N}\nDA:1,1\nDA:2,0\nDA:3,5\nFNF:2\nFNH:1\nend_of_record\nSF:b\nLF:10\nLH:1\nend_of_record\n", [(N, "2 / 1", "1 / 1", "0 / 0", "66.7%"), ("b", "1 / 9", "0 / 0", "0 / 0", "10.0%"), ("(total)", "3 / 10", "1 / 1", "0 / 0", "23.1%")]),
    # graphs and trees
    "dot": (f'digraph g {{ rankdir=LR; node [shape=box]; a [label="{N}"]; a -> b{K} -> c [label="x"]; }}', [("node", "a", N, None, None), ("node", f"b{K}", f"b{K}", None, None), ("node", "c", "c", None, None), ("edge", "directed", "x", "a", f"b{K}"), ("edge", "directed", "x", f"b{K}", "c")]),
    "mermaid": (f"graph TD\n  a[{N}] -->|yes| b{K}(round)\n  b{K} --- c & d\n", [("node", "a", N, None, None), ("node", f"b{K}", "round", None, None), ("node", "c", "c", None, None), ("node", "d", "d", None, None), ("edge", "directed", "yes", "a", f"b{K}"), ("edge", "undirected", None, f"b{K}", "c"), ("edge", "undirected", None, f"b{K}", "d")]),
    "d2": (f"a: {N}\na -> b{K}: go\nc <- a\n", [("node", "a", N, None, None), ("node", f"b{K}", f"b{K}", None, None), ("node", "c", "c", None, None), ("edge", "directed", "go", "a", f"b{K}"), ("edge", "directed", None, "a", "c")]),
    "plantuml": (f"@startuml\nactor A{K}\nA{K} -> B : {N}\nB ..> C\n@enduml\n", [("node", f"A{K}", f"A{K}", None, None), ("node", "B", "B", None, None), ("node", "C", "C", None, None), ("edge", "directed", N, f"A{K}", "B"), ("edge", "dashed", None, "B", "C")]),
    "graphml": (f'<graphml><key id="d" attr.name="label"/><graph edgedefault="directed"><node id="a"><data key="d">{N}</data></node><node id="{K}x"/><edge source="a" target="{K}x"/></graph></graphml>', [("node", "a", N, None, None), ("node", f"{K}x", f"{K}x", None, None), ("edge", "directed", None, "a", f"{K}x")]),
    "gexf": (f'<gexf><graph defaultedgetype="directed"><nodes><node id="a" label="{N}"/><node id="{K}x" label="b"/></nodes><edges><edge source="a" target="{K}x" label="e"/></edges></graph></gexf>', [("node", "a", N, None, None), ("node", f"{K}x", "b", None, None), ("edge", "directed", "e", "a", f"{K}x")]),
    "xgmml": (f'<graph directed="1"><node id="a" label="{N}"/><node id="b"/><edge source="a" target="b" label="{K}"/></graph>', [("node", "a", N, None, None), ("node", "b", "b", None, None), ("edge", "directed", K, "a", "b")]),
    "graphgml": (f'graph [ directed 1 node [ id 1 label "{N}" ] node [ id 2 ] edge [ source 1 target 2 label "e{K}" ] ]', [("node", "1", N, None, None), ("node", "2", "2", None, None), ("edge", "directed", f"e{K}", "1", "2")]),
    "newick": (f"(a:0.5,(b_{K}:1,'c d':2):{V})r;", [("1", "0", None, "r", None, "0"), ("1", "1", "0", "a", "0.5", "1"), ("1", "2", "0", None, V, "1"), ("1", "3", "2", f"b {K}", "1", "2"), ("1", "4", "2", "c d", "2", "2")]),
    "nexus": (f"#NEXUS\nBEGIN TREES;\n TRANSLATE 1 {N}, 2 b;\n TREE t = [&R] (1,2);\nEND;\n", [("1", "0", None, None, None, "0"), ("1", "1", "0", N, None, "1"), ("1", "2", "0", "b", None, "1")]),
    # maps
    "geojson": (f'{{"type":"FeatureCollection","features":[{{"type":"Feature","id":{K},"properties":{{"n":"{N}"}},"geometry":{{"type":"Point","coordinates":[1.5,{V}]}}}},{{"type":"Feature","properties":null,"geometry":{{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}}}]}}', [("0", K, "n", N, f"POINT (1.5 {V})"), ("1", None, None, None, "POLYGON ((0 0, 1 0, 1 1, 0 0))")]),
    "geojsonseq": (f'{{"type":"Feature","properties":{{"k":{K}}},"geometry":null}}\n{{"type":"LineString","coordinates":[[0,0],[1,{V}]]}}\n', [("0", None, "k", K, None), ("1", None, None, None, f"LINESTRING (0 0, 1 {V})")]),
    "topojson": (f'{{"type":"Topology","transform":{{"scale":[2,2],"translate":[1,0]}},"arcs":[[[0,0],[1,1]],[[3,3],[-2,-2]]],"objects":{{"o":{{"type":"LineString","id":"{K}","arcs":[0,-2],"properties":{{"n":"{N}"}}}}}}}}', [("0", K, "n", N, "LINESTRING (1 0, 3 2, 7 6)")]),
    "wkt": (f"SRID=4326;POINT (1 {K})\nMULTIPOINT ((0 0), (1 {V}))\n", [("0", "4326", "POINT", "1", f"(1 {K})"), ("1", None, "MULTIPOINT", "2", f"((0 0), (1 {V}))")]),
    "gpx": (f'<gpx><wpt lat="1.5" lon="2"><name>{N}</name><ele>{K}</ele></wpt><trk><trkseg><trkpt lat="0" lon="{V}"/></trkseg></trk></gpx>', [("waypoint", N, "0", "1.5", "2", K, None), ("track", None, "0", "0", V, None, None)]),
    "kml": (f"<kml><Document><Placemark><name>{N}</name><Point><coordinates>1,{K},0</coordinates></Point></Placemark><Placemark><LineString><coordinates>0,0 1,{V}</coordinates></LineString></Placemark></Document></kml>", [(N, None, f"POINT (1 {K})"), (None, None, f"LINESTRING (0 0, 1 {V})")]),
    "gml": (f'<FeatureCollection><featureMember><Town id="t{K}"><geom><Point srsName="urn:ogc:def:crs:EPSG::4326"><pos>50 {V}</pos></Point></geom></Town></featureMember></FeatureCollection>', [("Town", f"t{K}", f"POINT ({V} 50)")]),
    "georss": (f"<rss><channel><item><title>{N}</title><point>45 {K}</point></item></channel></rss>", [(N, "point", f"POINT ({K} 45)")]),
    "esri_ascii_grid": ("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9999\n1 3\n-9999 5\n", [("0", "0", "1", "0"), ("0", "1", "3", "0.5"), ("1", "0", None, None), ("1", "1", "5", "1")]),
    "opendrive": (f'<OpenDRIVE><road id="{K}" name="{N}"><planView><geometry s="0" x="1" y="2" hdg="0" length="{V}"><arc curvature="0.1"/></geometry></planView></road></OpenDRIVE>', [(K, N, "arc", "0", "1", "2", "0", V, "0.1")]),
    # meshes, molecules, drawings
    "obj": (f"# {N}\nv 0 0 {K}\nv 1 0 0\nv 0 1 0\nf 1/1 2//2 -1\n", [("v", "0", "0", "0", K, None), ("v", "1", "1", "0", "0", None), ("v", "2", "0", "1", "0", None), ("f", "0", None, None, None, "0 1 2")]),
    "off": (f"OFF\n3 1 0\n0 0 {K}\n1 0 0\n0 1 0\n3 0 1 2\n", [("v", "0", "0", "0", K, None), ("v", "1", "1", "0", "0", None), ("v", "2", "0", "1", "0", None), ("f", "0", None, None, None, "0 1 2")]),
    "stl": (f"solid {N}\nfacet normal 0 0 1\nouter loop\nvertex 0 0 {K}\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid\n", [("v", "0", "0", "0", K, None), ("v", "1", "1", "0", "0", None), ("v", "2", "0", "1", "0", None), ("f", "0", None, None, None, "0 1 2")]),
    "ply": (f"ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 {K}\n1 0 0\n0 1 0\n3 0 1 2\n", [("v", "0", "0", "0", K, None), ("v", "1", "1", "0", "0", None), ("v", "2", "0", "1", "0", None), ("f", "0", None, None, None, "0 1 2")]),
    "pcd": (f"# .PCD\nVERSION 0.7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 1\nHEIGHT 1\nPOINTS 1\nDATA ascii\n1 2 {K}\n", [("v", "0", "1", "2", K, None)]),
    "xyz": (f"x y z\n1 2 {K} 255 0\n3,4,5\n", [("v", "0", "1", "2", K, "255 0"), ("v", "1", "3", "4", "5", None)]),
    "pts": (f"1\n1 2 {K} 9\n", [("v", "0", "1", "2", K, "9")]),
    "ptx": (f"1\n2\n0 0 0\n1 0 0\n0 1 0\n0 0 1\n1 0 0 0\n0 1 0 0\n0 0 1 0\n10 0 0 1\n1 2 {K} 0.5\n0 0 0 0.5\n", [("v", "0", "11", "2", K, "0.5")]),
    "amf": (f"<amf><object><mesh><vertices><vertex><coordinates><x>0</x><y>0</y><z>{K}</z></coordinates></vertex><vertex><coordinates><x>1</x><y>0</y><z>0</z></coordinates></vertex><vertex><coordinates><x>0</x><y>1</y><z>0</z></coordinates></vertex></vertices><volume><triangle><v1>0</v1><v2>1</v2><v3>2</v3></triangle></volume></mesh></object></amf>", [("v", "0", "0", "0", K, None), ("v", "1", "1", "0", "0", None), ("v", "2", "0", "1", "0", None), ("f", "0", None, None, None, "0 1 2")]),
    "x3d": (f'<X3D><Scene><Shape><IndexedFaceSet coordIndex="0 1 2 -1"><Coordinate point="0 0 {K}, 1 0 0, 0 1 0"/></IndexedFaceSet></Shape></Scene></X3D>', [("v", "0", "0", "0", K, None), ("v", "1", "1", "0", "0", None), ("v", "2", "0", "1", "0", None), ("f", "0", None, None, None, "0 1 2")]),
    "vrml": (f"#VRML V2.0 utf8\nShape {{ geometry IndexedFaceSet {{ coord Coordinate {{ point [ 0 0 {K}, 1 0 0, 0 1 0 ] }} coordIndex [ 0 1 2 -1 ] }} }}\n", [("v", "0", "0", "0", K, None), ("v", "1", "1", "0", "0", None), ("v", "2", "0", "1", "0", None), ("f", "0", None, None, None, "0 1 2")]),
    "collada": (f'<COLLADA><library_geometries><geometry><mesh><source id="p"><float_array>0 0 {K} 1 0 0 0 1 0</float_array></source><vertices id="v"><input semantic="POSITION" source="#p"/></vertices><triangles><input semantic="VERTEX" source="#v" offset="0"/><input semantic="NORMAL" source="#n" offset="1"/><p>0 0 1 0 2 0</p></triangles></mesh></geometry></library_geometries></COLLADA>', [("v", "0", "0", "0", K, None), ("v", "1", "1", "0", "0", None), ("v", "2", "0", "1", "0", None), ("f", "0", None, None, None, "0 1 2")]),
    "su2": (f"NDIME= 2\nNELEM= 1\n5 0 1 2 0\nNPOIN= 3\n0 {K} 0\n1 0 1\n0 1 2\nNMARK= 1\nMARKER_TAG= w{V}\nMARKER_ELEMS= 1\n3 0 1\n", [("v", "0", "0", K, "0", None), ("v", "1", "1", "0", "0", None), ("v", "2", "0", "1", "0", None), ("f", "0", None, None, None, "0 1 2"), (f"marker w{V}", "0", None, None, None, "0 1")]),
    "medit": (f"MeshVersionFormatted 1\nDimension 3\nVertices 3\n0 0 {K} 0\n1 0 0 0\n0 1 0 0\nTriangles 1\n1 2 3 0\nEnd\n", [("v", "0", "0", "0", K, None), ("v", "1", "1", "0", "0", None), ("v", "2", "0", "1", "0", None), ("f", "0", None, None, None, "0 1 2")]),
    "abaqus": (f"*HEADING\n** c\n*NODE\n10, 0, 0, {K}\n20, 1, 0, 0\n30, 0, 1, 0\n*ELEMENT, TYPE=S3\n1, 10, 20, 30\n", [("v", "0", "0", "0", K, None), ("v", "1", "1", "0", "0", None), ("v", "2", "0", "1", "0", None), ("f", "0", None, None, None, "0 1 2")]),
    "nastran": (f"BEGIN BULK\nGRID,1,,0.,0.,{K}.\nGRID,2,,1.,0.,0.\nGRID,3,,0.,1.0+0,0.\nCTRIA3,1,1,1,2,3\nENDDATA\n", [("v", "0", "0", "0", K, None), ("v", "1", "1", "0", "0", None), ("v", "2", "0", "1", "0", None), ("f", "0", None, None, None, "0 1 2")]),
    "lsdyna": (f"*KEYWORD\n*NODE\n1,0,0,{K}\n2,1,0,0\n3,0,1,0\n*ELEMENT_SHELL\n1,1,1,2,3,3\n*END\n", [("v", "0", "0", "0", K, None), ("v", "1", "1", "0", "0", None), ("v", "2", "0", "1", "0", None), ("f", "0", None, None, None, "0 1 2")]),
    "simulation": (f"$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$Nodes\n3\n1 0 0 {K}\n2 1 0 0\n3 0 1 0\n$EndNodes\n$Elements\n1\n1 2 2 0 0 1 2 3\n$EndElements\n", [("v", "0", "0", "0", K, None), ("v", "1", "1", "0", "0", None), ("v", "2", "0", "1", "0", None), ("f", "0", None, None, None, "0 1 2")]),
    "unv": (f"    -1\n  2411\n 1 1 1 11\n 0.0 0.0 {K}.0D+00\n 2 1 1 11\n 1.0 0.0 0.0\n 3 1 1 11\n 0.0 1.0 0.0\n    -1\n    -1\n  2412\n 1 91 1 1 7 3\n 1 2 3\n    -1\n", [("v", "0", "0", "0", K, None), ("v", "1", "1", "0", "0", None), ("v", "2", "0", "1", "0", None), ("f", "0", None, None, None, "0 1 2")]),
    "tecplot": (f'TITLE = "t"\nVARIABLES = "X" "Y" "Z"\nZONE N=3, E=1, DATAPACKING=POINT, ZONETYPE=FETRIANGLE\n0 0 {K}\n1 0 0\n0 1 0\n1 2 3\n', [("v", "0", "0", "0", K, None), ("v", "1", "1", "0", "0", None), ("v", "2", "0", "1", "0", None), ("f", "0", None, None, None, "0 1 2")]),
    "plot3d": (f"2 2 1\n0 1 0 1\n0 0 1 1\n0 0 0 {K}\n", [("v", "0", "0", "0", "0", None), ("v", "1", "1", "0", "0", None), ("v", "2", "0", "1", "0", None), ("v", "3", "1", "1", K, None), ("f", "0", None, None, None, "0 1 3 2")]),
    "ifc": (f"ISO-10303-21;\nHEADER;\nENDSEC;\nDATA;\n#1=IFCWALL('{N}',#2,(#3,#4));\n#2= IFCPOINT ((0.,{K}.));\nENDSEC;\nEND-ISO-10303-21;\n", [("1", "IFCWALL", f"'{N}',#2,(#3,#4)", "2 3 4"), ("2", "IFCPOINT", f"(0.,{K}.)", None)]),
    "step": (f"ISO-10303-21;\nHEADER;\nENDSEC;\nDATA;\n#10=CARTESIAN_POINT('',(0.,{K}.,1.));\nENDSEC;\nEND-ISO-10303-21;\n", [("10", "CARTESIAN_POINT", f"'',(0.,{K}.,1.)", None)]),
    "pdb": ("HEADER    X\nATOM      1  CA  GLY A   7      11.104   6.134  -6.504  1.00  0.00           C  \nEND\n", [("1", "1", "CA", "GLY", "A", "7", "11.104", "6.134", "-6.504", "C")]),
    "cif": (f"data_{N}\nloop_\n_atom_site.group_PDB\n_atom_site.id\n_atom_site.type_symbol\n_atom_site.label_atom_id\n_atom_site.label_comp_id\n_atom_site.label_asym_id\n_atom_site.label_seq_id\n_atom_site.Cartn_x\n_atom_site.Cartn_y\n_atom_site.Cartn_z\nATOM {K} C CA GLY A 7 1.5 2 3\n#\n", [("1", K, "CA", "GLY", "A", "7", "1.5", "2", "3", "C")]),
    "mol": (f"{N}\n  x\n\n  2  1  0  0  0  0            999 V2000\n    0.0000    0.0000    0.0000 C   0  0\n    1.5000    0.0000    0.0000 O   0  0\n  1  2  2  0\nM  END\n", [("1", N, "atom", "1", "C", "0", "0", "0", None), ("1", N, "atom", "2", "O", "1.5", "0", "0", None), ("1", N, "bond", "1", "2", None, None, None, "1 2")]),
    "sdf": (f"{N}\n  x\n\n  1  0  0  0  0  0            999 V2000\n    0.0000    0.0000    0.0000 N   0  0\nM  END\n$$$$\n", [("1", N, "atom", "1", "N", "0", "0", "0", None)]),
    "rxn": (f"$RXN\n\n\n\n  1  0\n$MOL\n{N}\n\n\n  1  0  0  0  0  0            999 V2000\n    0.0000    0.0000    0.0000 N   0  0\nM  END\n", [("1", N, "atom", "1", "N", "0", "0", "0", None)]),
    "mol2": (f"@<TRIPOS>MOLECULE\n{N}\n 2 1\n@<TRIPOS>ATOM\n1 C1 0.0 0.0 1.5 C.3\n2 O1 1.0 0.0 0.0 O.2\n@<TRIPOS>BOND\n1 1 2 2\n", [("1", N, "atom", "1", "C", "0", "0", "1.5", None), ("1", N, "atom", "2", "O", "1", "0", "0", None), ("1", N, "bond", "1", "2", None, None, None, "1 2")]),
    "gcode": (f"G21 ; mm\nG0 X1 Y2\nG1 Z-1 (down)\nG90\nX{K}\nG92 X0\n", [("2", "rapid", "0", "0", "0", "1", "2", "0"), ("3", "line", "1", "2", "0", "1", "2", "-1"), ("5", "line", "1", "2", "-1", K, "2", "-1")]),
    "excellon": ("M48\nMETRIC\nT1C0.8\n%\nT1\nX1.5Y2.0\nX2500\nM30\n", [("1", "1", "0.8", "1.5", "2", "mm"), ("2", "1", "0.8", "2.5", "2", "mm")]),
    "gerber": ("%FSLAX24Y24*%\n%MOIN*%\n%ADD10C,0.5*%\nD10*\nX10000Y20000D02*\nX30000D01*\nD03*\nM02*\n", [("1", "move", "C,0.5", "0", "0", "1", "2"), ("2", "draw", "C,0.5", "1", "2", "3", "2"), ("3", "flash", "C,0.5", "3", "2", "3", "2")]),
    "hpgl": ("IN;SP2;PU0,0;PD100,0,100,50;PR;PU-10,5;", [("1", "move", "2", "0", "0", "0", "0"), ("2", "draw", "2", "0", "0", "100", "0"), ("3", "draw", "2", "100", "0", "100", "50"), ("4", "move", "2", "100", "50", "90", "55")]),
    "dxf": (f"0\nSECTION\n2\nENTITIES\n0\nLINE\n8\nL{V}\n10\n0\n20\n1\n11\n2\n21\n{K}\n0\nTEXT\n8\n0\n10\n5\n20\n6\n40\n2.5\n1\n{N}\n0\nENDSEC\n0\nEOF\n", [("LINE", f"L{V}", f"0 1, 2 {K}", None, None), ("TEXT", "0", "5 6", "2.5", N)]),
    "kicad_pcb": (f'(kicad_pcb (version 1) (net 1 "{N}") (segment (start 0 1) (end 2 {K}) (layer "F.Cu") (net 1)))', [("net", f"1 {N}", None, None, None), ("segment", None, "F.Cu", f"0 1, 2 {K}", "1")]),
    "eagle_sch": (f'<eagle><drawing><schematic><parts><part name="R{K}" value="{N}"/></parts><sheets><sheet><instances><instance part="R{K}" gate="G" x="1" y="2"/></instances><nets><net name="n"><segment><wire x1="0" y1="0" x2="1" y2="1" layer="91"/></segment></net></nets></sheet></sheets></schematic></drawing></eagle>', [("part", f"R{K}", None, None, N), ("instance", f"R{K}", None, "1 2", "G"), ("wire", "n", "91", "0 0, 1 1", "n")]),
    "ltspice_asc": (f"Version 4\nSHEET 1 880 680\nWIRE 0 1 2 {K}\nFLAG 0 1 0\nSYMBOL res 16 32 R0\nSYMATTR InstName R1\nSYMATTR Value {V}k\n", [("wire", None, None, f"0 1 2 {K}", None), ("flag", "0", None, "0 1", None), ("symbol", "R1", "res", "16 32", f"{V}k")]),
    "openfoam-field": ("FoamFile { class volVectorField; object U; }\ninternalField nonuniform List<vector> 2 ((3 4 0) (0 0 1));\nboundaryField { inlet { type x; } wall { type y; } }\n", [("U", "volVectorField", "nonuniform", "2", "1", "5", "inlet, wall")]),
    "eps": (f"%!PS-Adobe-3.0 EPSF-3.0\n%%BoundingBox: 0 0 10 {K}\n%%Title: {N}\n0 0 moveto 1 1 lineto 2 2 lineto stroke\n", [("Comment", "BoundingBox", f"0 0 10 {K}"), ("Comment", "Title", N), ("Operator", "lineto", "2"), ("Operator", "moveto", "1"), ("Operator", "stroke", "1")]),
    "kicad_sch": (f'(kicad_sch (wire (pts (xy 0 1) (xy 2 {K}))) (label "{N}" (at 1 2 0)))', [("wire", None, None, f"0 1, 2 {K}", None), ("label", N, None, "1 2 0", None)]),
    "kicad_sch_legacy": (f'EESchema Schematic File Version 4\nWire Wire Line\n\t0 1 2 {K}\n$Comp\nL lib:R R{K}\nP 10 20\nF 0 "R{K}" H 1 1 1\nF 1 "{N}" H 1 1 1\n$EndComp\nConnection ~ 5 6\n', [("wire", None, None, f"0 1 2 {K}", None), ("component", f"R{K}", "lib:R", "10 20", N), ("connection", None, None, "5 6", None)]),
    "sat": ("700 0 1 0\n11 x 1 2 3\n1 1e-06 1e-10\nbody $-1 -1 $1 #\nlump $-1 -1 $2 #\npoint $-1 -1 0 0 1 #\npoint $-1 -1 1 0 1 #\n", [("body", "1", None), ("lump", "1", None), ("point", "2", None)]),
    "rinex": (f"     3.03           OBSERVATION DATA    M                   RINEX VERSION / TYPE\n{{:<60}}MARKER NAME\n{{:<60}}END OF HEADER\n> 2020 01 01 00 00  0.0\nG01 1\n> 2020 01 01 00 00 30.0\n".format("m", ""), [("Version", "3.03", "OBSERVATION DATA"), ("Marker", "m", None), ("Epochs", "2", None)]),
    "pdf": (f"%PDF-1.4\n1 0 obj\n<< /Type /Page /Parent 2 0 R >>\nendobj\n4 0 obj\n<< /Length 9 >>\nstream\nBT /F1 12 Tf ({N} \\(a\\)) Tj T* [(k) -20 ({K})] TJ ET\nendstream\nendobj\n%%EOF", [("version", "1.4"), ("pages", "1"), ("text", f"{N} (a)"), ("text", f"k{K}")]),
    "fdf": (f"%FDF-1.2\n1 0 obj\n<< /FDF << /Fields [ << /T (name) /V ({N}) >> << /T (Password) /V (x{K}) >> << /T (c) /V /Yes >> ] >> >>\nendobj\n", [("name", "text", N, None), ("Password", "text", "***", None), ("c", "name", "Yes", None)]),
    "tex": (f"\\documentclass{{article}}\n\\begin{{document}}\n% c\n\\section{{{N} \\& co}}\nSome \\emph{{words}} {K}\nmore.\n\n\\subsection*{{s}}\n\\begin{{itemize}}\n\\item one\n\\item two\n\\end{{itemize}}\n\\begin{{verbatim}}\nx  y\n\\end{{verbatim}}\n\\begin{{tabular}}{{ll}}\na & {V} \\\\\nb & 2\n\\end{{tabular}}\n\\end{{document}}\n".replace("#", "\\#"), [("heading", "1", f"{N} & co"), ("paragraph", "0", f"Some words {K} more."), ("heading", "2", "s"), ("item", "1", "one"), ("item", "1", "two"), ("code", "0", "x  y"), ("row", "2", f"a\t{V}"), ("row", "2", "b\t2")]),
    "ifcxml": (f'<ifcXML><IfcWall id="i{K}" Name="{N}"><Place ref="p"/><Tag>t</Tag></IfcWall></ifcXML>', [(f"i{K}", "IfcWall", f"Name={N}; Tag=t", "p")]),
    "cdb": (f"/PREP7\nNBLOCK,6,SOLID,3,3\n(3i9,6e21.13e3)\n{{:>9}}{{:>9}}{{:>9}}{{:>21}}{{:>21}}{{:>21}}\n{{:>9}}{{:>9}}{{:>9}}{{:>21}}\nN,R5.3,LOC,-1,\n".format(1, 0, 0, "0.0", "1.0", "2.0", 2, 0, 0, "5.0"), [("v", "0", "0", "1", "2", None), ("v", "1", "5", "0", "0", None)]),
    "ensight": (f"d1\nd2\nnode id off\nelement id off\npart\n1\n{N}\ncoordinates\n3\n0\n1\n0\n0\n0\n1\n{K}\n0\n0\ntria3\n1\n1 2 3\n", [("v", "0", "0", "0", K, None), ("v", "1", "1", "0", "0", None), ("v", "2", "0", "1", "0", None), ("f", "0", None, None, None, "0 1 2")]),
    # packages
    "ifczip": ({"m.ifc": f"ISO-10303-21;\nDATA;\n#1=IFCWALL('{N}');\nENDSEC;\n"}, [("1", "IFCWALL", f"'{N}'", None)]),
    "bcfzip": ({"t1/markup.bcf": f'<Markup><Topic TopicType="Issue" TopicStatus="Open"><Title>{N}</Title></Topic><Comment/><Comment/></Markup>', "t1/v.bcfv": "<v/>"}, [("Topic", N, "Issue / Open"), ("Comments", "2", "t1"), ("Viewpoints", "1", None), ("Snapshots", "0", None)]),
    "idml": ({"designmap.xml": "<d/>", "Stories/Story_1.xml": f"<s><Content>{N}</Content><Content>b</Content></s>", "Spreads/a.xml": "<s/>"}, [("Package", "3", None), ("Layout", "1", "Spreads"), ("Resources", "0", "Resources"), ("Text", "1", "Stories"), ("Story", "Story_1.xml", f"{N}b")]),
    "xps": ({"Documents/1/Pages/1.fpage": f'<FixedPage><Glyphs OriginX="1" OriginY="{K}" FontRenderingEmSize="12" UnicodeString="{N}"/></FixedPage>'}, [("1", "1", K, "12", N)]),
    "odg": ({"content.xml": f'<o xmlns:draw="urn:d" xmlns:svg="urn:s" xmlns:text="urn:t"><draw:page><draw:rect svg:x="1cm" svg:y="{K}cm" svg:width="2cm" svg:height="3cm"><text:p>{N}</text:p></draw:rect></draw:page></o>'}, [("1", "rect", f"1cm {K}cm 2cm 3cm", N)]),
    "docx": (
        {"_rels/.rels": _OFFICE.format("word/document.xml"), "word/_rels/document.xml.rels": '<Relationships><Relationship Id="r1" Type="x/styles" Target="styles.xml"/></Relationships>', "word/styles.xml": '<w:styles xmlns:w="w"><w:style w:styleId="S"><w:basedOn w:val="B"/></w:style><w:style w:styleId="B"><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style></w:styles>', "word/document.xml": f'<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="S"/></w:pPr><w:r><w:t>{N}</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:delText>no</w:delText></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr><w:r><w:t>i</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>{K}</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'},
        [("heading", "2", N), ("paragraph", "0", "a\tb"), ("item", "2", "i"), ("row", "2", f"k\t{K}")],
    ),
    "pptx": (
        {"_rels/.rels": _OFFICE.format("ppt/presentation.xml"), "ppt/presentation.xml": '<p:presentation xmlns:p="p" xmlns:r="r"><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Type="x/slide" Target="slides/s1.xml"/></Relationships>', "ppt/slides/s1.xml": f'<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{N}</a:t></a:r></a:p></p:txBody></p:sp><p:sp><p:txBody><a:p><a:r><a:t>b{K}</a:t></a:r></a:p></p:txBody></p:sp></p:sld>'},
        [("1", "title", N), ("1", "paragraph", f"b{K}")],
    ),
    "xlsx": (
        {"_rels/.rels": _OFFICE.format("xl/workbook.xml"), "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Type="x/worksheet" Target="/xl/worksheets/a.xml"/><Relationship Id="r2" Type="x/sharedStrings" Target="ss.xml"/></Relationships>', "xl/ss.xml": f"<sst><si><t>{N}</t></si></sst>", "xl/worksheets/a.xml": f'<worksheet><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c><v>{K}</v></c><c r="E2" t="b"><f>A1=1</f><v>1</v></c></row><row><c t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>'},
        [("S", "B2", "text", N, None, None), ("S", "C2", "number", K, None, None), ("S", "E2", "boolean", "TRUE", "A1=1", None), ("S", "A3", "text", "x", None, None)],
    ),
    "odt": ({"content.xml": f"<office:document-content {_ODF}><office:body><office:text><text:h text:outline-level=\"2\">{N}</text:h><text:p>a<text:s text:c=\"2\"/>b</text:p><text:list><text:list-item><text:p>i{K}</text:p></text:list-item></text:list></office:text></office:body></office:document-content>"}, [("heading", "2", N), ("paragraph", "0", "a  b"), ("item", "1", f"i{K}")]),
    "ods": ({"content.xml": f'<office:document-content {_ODF}><office:body><office:spreadsheet><table:table table:name="T"><table:table-row><table:table-cell office:value-type="float" office:value="{K}" table:formula="of:=1"><text:p>x</text:p></table:table-cell><table:table-cell table:number-columns-repeated="2"/><table:table-cell office:value-type="string"><text:p>{N}</text:p></table:table-cell></table:table-row></table:table></office:spreadsheet></office:body></office:document-content>'}, [("T", "A1", "float", K, "of:=1", None), ("T", "D1", "string", N, None, None)]),
    "odp": ({"content.xml": f"<office:document-content {_ODF}><office:body><office:presentation><draw:page><draw:frame><text:p>{N}</text:p></draw:frame></draw:page></office:presentation></office:body></office:document-content>"}, [("1", "paragraph", N)]),
    "epub": ({"META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>', "o/c.opf": f'<package xmlns:dc="d"><metadata><dc:title>{N}</dc:title></metadata><manifest><item id="b" href="b.html"/><item id="a" href="a.html"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>', "o/a.html": f"<h2>a{K}</h2>", "o/b.html": "<p>b</p>"}, [("title", "0", N), ("heading", "2", f"a{K}"), ("paragraph", "0", "b")]),
    "kmz": ({"doc.kml": f"<kml><Placemark><name>{N}</name><Point><coordinates>1,{K}</coordinates></Point></Placemark></kml>"}, [(N, None, f"POINT (1 {K})")]),
    "cbz": ({"p10.png": "xx", "p2.png": "x", "a.txt": "no"}, [("1", "p2.png", "1"), ("2", "p10.png", "2")]),
    "threemf": ({"3D/m.model": f'<model><resources><object><mesh><vertices><vertex x="0" y="0" z="{K}"/><vertex x="1" y="0" z="0"/><vertex x="0" y="1" z="0"/></vertices><triangles><triangle v1="0" v2="1" v3="2"/></triangles></mesh></object></resources></model>'}, [("v", "0", "0", "0", K, None), ("v", "1", "1", "0", "0", None), ("v", "2", "0", "1", "0", None), ("f", "0", None, None, None, "0 1 2")]),
    "wacz": ({"datapackage.json": "{}", "pages/pages.jsonl": f'{{"format":"json-pages-1.0"}}\n{{"id":"{K}","url":"http://h/?token=1","title":"{N}","ts":"2020"}}\n'}, [(K, "http://h/?token=***", "", f"{N} / 2020")]),
    "xmind": ({"content.json": f'[{{"title":"s","rootTopic":{{"title":"{N}","children":{{"attached":[{{"title":"c{K}"}}]}}}}}}]'}, [("sheet", "0", "s"), ("topic", "1", N), ("topic", "2", f"c{K}")]),
    "hwpx": ({"Contents/section0.xml": f"<sec><p><run><t>{N}</t></run></p><p/></sec>"}, [("paragraph", "0", N)]),
    "omex": ({"manifest.xml": f'<omexManifest><content location="./m{K}.xml" format="f"/></omexManifest>', "m.xml": "<x/>"}, [("Archive", "2", "1 listed"), ("Content", f"./m{K}.xml", "f")]),
}


def _counted(roots: str, kinds: dict[str, str]) -> tuple:
    """A file with one element of each kind's first name and two of its second, and what counting them gives."""
    root = roots.split()[0] if roots else "root"
    names = [n for group in kinds.values() for k, n in enumerate(group.split()[:2]) for _ in range(k + 1)]
    seen = Counter([root, *names])
    rows = [("Document", root, f"u{K}")]
    for kind, group in kinds.items():
        found = [(n, seen[n]) for n in group.split() if seen[n]]
        rows.append((kind, str(sum(n for _, n in found)), " ".join(f"{k}={n}" for k, n in found)))
    return f'<{root} xmlns="u{K}">' + "".join(f'<{n} name="{N}"/>' for n in names) + f"</{root}>", rows


CASES |= {k: _counted(*v) for k, v in KINDS.items() if k not in CASES}


def fill(template: str, row: dict) -> str:
    return re.sub(r"<<(\w+)>>", lambda m: str(row[m[1]]), template)


def content_of(case, row: dict) -> bytes:
    if isinstance(case, str):
        return fill(case, row).encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, part in case.items():
            z.writestr(zipfile.ZipInfo(name), fill(part, row))
    return out.getvalue()


def _written(case):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.record_batch([pa.array([str(r["s_suppkey"]) for r in rows], pa.string()), pa.array([content_of(case, r) for r in rows], pa.binary())], names=["path", "content"])

    return run


def query(name: str):
    def run(spark, sf_dir: str) -> DataFrame:
        """Files made of every supplier, read; (file_path, ord, the format's columns, error)."""
        rows = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
        return extract(rows.mapInArrow(_written(CASES[name][0]), "path string, content binary"), name)

    return run


def oracle(name: str, rows: list[tuple] | None = None) -> str:
    """The rows that the files must give (the case's, or ``rows``), from the table alone."""

    def value(t: str | None) -> str:
        if t is None:
            return "CAST(NULL AS VARCHAR)"
        parts = re.split(r"<<(\w+)>>", t)
        quoted = ["'" + p.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" if i % 2 == 0 else f"CAST({p} AS VARCHAR)" for i, p in enumerate(parts)]
        return " || ".join(q for q in quoted if q != "''") or "''"

    columns = formats()[name].columns
    rows = CASES[name][1] if rows is None else rows
    each = [f"SELECT CAST(s_suppkey AS VARCHAR) AS file_path, CAST({n} AS BIGINT) AS ord, " + ", ".join(f'{value(v)} AS "{c}"' for c, v in zip(columns, r, strict=True)) + ", CAST(NULL AS VARCHAR) AS error FROM supplier" for n, r in enumerate(rows)]
    return "\nUNION ALL ".join(each)


QUERIES = {f"read_{k.replace('-', '_')}": query(k) for k in CASES}
ORACLES = {f"read_{k.replace('-', '_')}": oracle(k) for k in CASES}
