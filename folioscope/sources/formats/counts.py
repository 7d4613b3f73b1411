"""XML formats of which the structure is counted and the content left out.

A row for the root, then one for each kind: how many of its elements there are, and of
each of them that occurs.  Which elements make a kind is a table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from ..files import Format
from .jsons import joined
from .xmltree import attr, every, kid, kids, name, own, parse, root_is, rooted, said, space

# Names that the formats' own schemas define, by kind.
KINDS = {
    "abiword": ("abiword", {"Text": "section p c table cell", "Resources": "image bookmark hyperlink link field", "Equations": "math equation"}),
    "b2mml": ("", {"Schedules": "ProductionSchedule ProductionPerformance ProductionRequest ProductionResponse", "Resources": "MaterialDefinition MaterialLot MaterialActual Equipment EquipmentClass EquipmentActual Personnel Person PersonnelActual", "Process": "ProductDefinition ProductSegment ProcessSegment SegmentRequirement SegmentResponse ProductionCapability EquipmentCapability Maintenance", "Transactions": "ApplicationArea Transaction ExternalReference File"}),
    "biopax": ("RDF", {"Entities": "Pathway Interaction PhysicalEntity", "Physical": "Protein SmallMolecule Complex", "Reactions": "BiochemicalReaction Control Catalysis", "Ontology": "Ontology PublicationXref"}),
    "cda": ("ClinicalDocument", {"Clinical entries": "entry observation act organizer", "Care context": "encounter procedure author participant assignedEntity", "Narrative": "section text list table templateId"}),
    "cellml": ("model", {"Model": "component variable connection map_components map_variables", "Units": "units unit", "Imports": "import encapsulation", "Equations": "math reset annotation"}),
    "cml": ("cml molecule", {"Molecule": "molecule reaction", "Atoms/bonds": "atom bond", "Properties": "property spectrum"}),
    "gbxml": ("gbXML", {"Building": "Campus Building BuildingStorey Space Zone", "Envelope": "Surface Opening ShellGeometry RectangularGeometry", "Materials": "Construction Material", "Systems": "AirLoop ZoneEquipments System Schedule DaySchedule People Occupant Occupants Location WeatherStation"}),
    "ipc2581": ("IPC-2581", {"Content": "Content LogisticHeader HistoryRec", "Parts": "BomItem AvlItem Component Package", "Board": "Ecad Board Layer Stackup Net Route PadstackDef Feature"}),
    "iso20022": ("Document", {"Message": "AppHdr FIToFICstmrCdtTrf CstmrCdtTrfInitn BkToCstmrStmt PmtStsRpt", "Payments": "PmtInf CdtTrfTxInf TxInfAndSts TxInf Amt InstdAmt ReqdExctnDt IntrBkSttlmDt CreDtTm", "Parties": "Dbtr Cdtr OrgnlPty DbtrAcct CdtrAcct Acct", "Remittance": "RmtInf Ustrd Strd"}),
    "jdf": ("JDF JMF", {"Nodes": "JDF Process ProcessGroup Product", "Resources": "ResourcePool Resource ResourceLink Component Device", "Print data": "Media RunList Layout", "References": "FileSpec URLLink URL Audit"}),
    "xjdf": ("XJDF", {"Nodes": "Product ProductList Process", "Resources": "ResourceSet Resource Component Device", "Print data": "Media RunList Layout", "References": "FileSpec URL Audit AuditPool"}),
    "landxml": ("LandXML", {"Surfaces": "Surface P Pnt F", "Alignments": "Alignment Line Curve Spiral", "Survey points": "CgPoint", "Parcels": "Parcel", "Pipe networks": "PipeNetwork Pipe Struct"}),
    "neuroml": ("neuroml", {"Cells": "cell iafCell izhikevich2007Cell morphology segment segmentGroup", "Networks": "network population projection connection connectionWD inputList input", "Synapses": "alphaSynapse expTwoSynapse synapse ionChannel channelDensity", "Imports": "include"}),
    "oaipmh": ("OAI-PMH", {"Verbs": "Identify ListRecords ListIdentifiers GetRecord ListMetadataFormats ListSets", "Records": "record header metadata setSpec", "Requests": "request metadataFormat set error", "Paging": "resumptionToken"}),
    "ocel-xml": ("log", {"Events": "event-type event", "Objects": "object-type object", "Attributes": "attribute relationship string integer float time boolean"}),
    "onix": ("ONIXMessage ONIXmessage", {"Products": "Product ProductIdentifier", "Description": "DescriptiveDetail Contributor Language Subject Measure TitleText", "Supply": "SupplyDetail Price PublishingStatus", "Resources": "CollateralDetail TextContent SupportingResource ResourceVersion"}),
    "opensearch": ("OpenSearchDescription", {"Search URLs": "Url Query", "Locales": "Language InputEncoding OutputEncoding", "Descriptor": "ShortName Description Image Developer Contact", "Rights": "SyndicationRight"}),
    "plmxml": ("PLMXML", {"Product structure": "ProductDef Part Structure Instance", "Representations": "Representation Geometry ConstructionGeometry", "Metadata": "Attribute ExternalReference ExternalData"}),
    "pvd": ("VTKFile", {"Collection": "Collection", "Files": "DataSet"}),
    "qif": ("QIFDocument", {"Product": "Product ProductDefinition Part Feature Datum", "Inspection": "MeasurementPlan InspectionPlan InspectionTraceability", "Measurements": "MeasurementResults QMResults MeasuredFeature FeatureMeasurement Measurement MeasuredPointSet Characteristic CharacteristicDefinition", "External files": "ExternalFileReference"}),
    "saml": ("EntityDescriptor EntitiesDescriptor", {"Entities": "EntityDescriptor IDPSSODescriptor SPSSODescriptor RoleDescriptor Organization ContactPerson", "Endpoints": "SingleSignOnService SingleLogoutService AssertionConsumerService ArtifactResolutionService", "Attributes": "Attribute RequestedAttribute", "Integrity": "KeyDescriptor KeyInfo X509Certificate Signature"}),
    "sbgnml": ("sbgn", {"Map": "map glyph arc submap", "Geometry": "bbox port", "Glyph state": "label state clone cloneMarker terminal callout"}),
    "sbml": ("sbml", {"Model": "model", "Network": "compartment species reaction", "Parameters": "parameter assignmentRule rateRule algebraicRule event unitDefinition functionDefinition", "Extensions": "annotation notes"}),
    "sedml": ("sedML", {"Experiment": "model simulation uniformTimeCourse oneStep steadyState algorithm", "Tasks": "task repeatedTask uniformRange vectorRange functionalRange", "Analysis": "dataDescription dataGenerator variable parameter changeAttribute computeChange addXML removeXML changeXML", "Outputs": "output plot2D plot3D report"}),
    "stepxml": ("iso_10303_28 uos", {"Products": "product product_definition product_definition_formation", "Assembly": "next_assembly_usage_occurrence assembly_component product_definition_relationship component_occurrence", "Geometry": "shape_representation representation geometric_representation_item advanced_brep_shape_representation manifold_surface_shape_representation cartesian_point direction", "Properties": "property_definition property_definition_representation external_reference document_file"}),
    "tbx": ("tbx martif", {"Terminology": "termEntry conceptEntry term tig termSec", "Languages": "langSet langSec", "Metadata": "descrip definition admin note transac transacGrp ref xref"}),
    "tmx": ("tmx", {"Translation units": "tu tuv seg", "Metadata": "header note prop"}),
    "wadl": ("application", {"Resources": "resource resource_type", "HTTP": "method request response representation param", "Schemas": "grammars include", "Documentation": "doc link"}),
    "xacml": ("Policy PolicySet", {"Policies": "PolicySet Policy Rule PolicyIdReference PolicySetIdReference", "Targets": "Target Condition Match Function", "Attributes": "AttributeDesignator AttributeSelector AttributeValue", "Effects": "ObligationExpressions Obligation AdviceExpressions Advice"}),
    "xdmf": ("Xdmf", {"Model": "Domain Grid", "Mesh": "Topology Geometry", "Data": "Attribute DataItem Time", "Functions": "Function Reference"}),
    "xdp": ("xdp", {"Packet": "template datasets config form", "Field": "field subform value dataValue", "Scripts": "script calculate validate event", "Connections": "submit submitUrl uri connection proto"}),
    "xpdl": ("Package", {"Workflow": "WorkflowProcess Activity Transition", "Roles": "Participant Pool Lane", "Integration": "Application DataField FormalParameter Connector ExtendedAttribute ExternalReference ExternalPackage"}),
    "xproc": ("declare-step pipeline library", {"Pipeline": "declare-step pipeline step identity", "Bindings": "input with-input output with-output option variable pipe", "Control": "choose when if for-each viewport group try catch", "Resources": "import include load store http-request"}),
    "xsd": ("schema", {"Declarations": "element attribute complexType simpleType group attributeGroup", "Compositors": "choice sequence all", "Derivation": "restriction extension", "Dependencies": "import include redefine override"}),
    "xsl-fo": ("root", {"Pages": "page-sequence layout-master-set simple-page-master page-sequence-master region-body region-before region-after region-start region-end", "Flows": "flow static-content", "Text": "block block-container inline inline-container list-block footnote page-number page-number-citation", "Tables": "table table-and-caption table-row table-cell", "Media": "external-graphic instream-foreign-object basic-link bookmark-tree bookmark"}),
    "xslt": ("stylesheet transform", {"Stylesheet": "template key output function", "Control": "apply-templates call-template for-each if when choose", "Bindings": "variable param", "Dependencies": "include import script"}),
}
SUFFIXES = {
    "abiword": ".abw .zabw", "b2mml": ".b2mml .b2mml.xml", "biopax": ".biopax .owl", "cda": ".cda .cda.xml", "cellml": ".cellml", "cml": ".cml", "gbxml": ".gbxml", "ipc2581": ".ipc2581 .cvg", "iso20022": ".iso20022.xml", "jdf": ".jdf .jmf", "xjdf": ".xjdf",
    "landxml": ".landxml", "neuroml": ".nml .neuroml", "oaipmh": ".oai.xml", "ocel-xml": ".xmlocel .ocel.xml", "onix": ".onix .onix.xml", "opensearch": ".osdx .opensearch.xml", "plmxml": ".plmxml", "pvd": ".pvd", "qif": ".qif", "saml": ".saml .saml.xml", "sbgnml": ".sbgn",
    "sbml": ".sbml", "sedml": ".sedml", "stepxml": ".stpx .p28", "tbx": ".tbx", "tmx": ".tmx", "wadl": ".wadl", "xacml": ".xacml", "xdmf": ".xdmf .xmf", "xdp": ".xdp", "xpdl": ".xpdl", "xproc": ".xpl", "xsd": ".xsd", "xsl-fo": ".fo", "xslt": ".xsl .xslt",
}


def counted(roots: str, kinds: dict[str, str]):
    def rows(data: bytes) -> Iterator[tuple]:
        root = rooted(data, *roots.split()) if roots else parse(data)
        seen = Counter(name(e) for e in root.iter() if isinstance(e.tag, str))
        yield "Document", name(root), space(root) or None
        for kind, names in kinds.items():
            found = [(n, seen[n]) for n in names.split() if seen[n]]
            yield kind, sum(n for _, n in found), joined((f"{k}={n}" for k, n in found), " ")

    return rows


def iso19115(data: bytes) -> Iterator[tuple]:
    root = rooted(data, "MD_Metadata", "MI_Metadata")
    first = lambda *n: said(next(every(root, *n), None))
    for kind, value in (("Title", first("title")), ("Date", first("Date", "DateTime")), ("Hierarchy level", first("MD_ScopeCode")), ("Language", first("language")), ("Topic", first("MD_TopicCategoryCode")), ("Reference system", first("RS_Identifier", "MD_Identifier"))):
        if value:
            yield kind, value, None
    for box in every(root, "EX_GeographicBoundingBox"):
        yield "Geographic bounding box", joined(said(x) for x in box), joined(name(x) for x in box)
    for kind, names in (("Resource links", ("CI_OnlineResource",)), ("Contacts", ("contact", "CI_ResponsibleParty", "CI_Responsibility")), ("Quality/constraints", ("dataQualityInfo", "resourceConstraints"))):
        yield kind, sum(1 for _ in every(root, *names)), None


def ubl(data: bytes) -> Iterator[tuple]:
    root = parse(data)
    if "oasis" not in space(root) or "ubl" not in space(root).lower():
        raise ValueError("not UBL")
    yield "Document", name(root), space(root)
    for kind, tag in (("UBL version", "UBLVersionID"), ("Issue date", "IssueDate"), ("Due date", "DueDate"), ("Currency", "DocumentCurrencyCode")):
        if own(root, tag):
            yield kind, own(root, tag), None
    lines = [e for e in root if name(e).endswith("Line")]
    yield "Line items", len(lines), joined(sorted({name(e) for e in lines}))
    for kind, names in (("Parties", ("AccountingSupplierParty", "AccountingCustomerParty", "BuyerCustomerParty")), ("Totals", ("TaxTotal", "LegalMonetaryTotal")), ("Payment structure", ("PaymentMeans", "PaymentTerms")), ("Adjustments", ("AllowanceCharge",)), ("References/attachments", ("Attachment", "AdditionalDocumentReference"))):
        yield kind, len([e for e in root if name(e) in names]), None


def fhir_xml(data: bytes) -> Iterator[tuple]:
    root = parse(data)
    if space(root) != "http://hl7.org/fhir":
        raise ValueError("not FHIR")
    resources = [x for r in every(root, "resource") for x in r] if name(root) == "Bundle" else [root]
    yield "Root", name(root), attr(kid(root, "id"), "value")
    for kind, n in sorted(Counter(map(name, resources)).items()):
        yield "Type", kind, n
    yield "Bundle entries", len(kids(root, "entry")), None
    yield "Extensions", sum(1 for _ in every(root, "extension", "modifierExtension")), None


def citygml(data: bytes) -> Iterator[tuple]:
    found: dict[str, list] = {}
    for member in every(rooted(data, "CityModel"), "cityObjectMember", "featureMember"):
        for o in member:
            row = found.setdefault(name(o), [0, Counter()])
            row[0] += 1
            row[1].update(m[1] for e in o.iter() if (m := re.match(r"lod([0-4])", name(e))))
    for kind in sorted(found):
        n, lods = found[kind]
        yield kind, n, sum(lods.values()), joined(f"LoD{k}={lods[k]}" for k in sorted(lods))


def linear(e) -> str:
    """A presentation formula as one line of text."""
    n, parts = name(e), [linear(x) for x in e]
    wrap = lambda s: s if len(s) < 2 else f"({s})"
    if n in ("mi", "mn", "mo", "mtext", "ms"):
        return said(e) or ""
    if n == "mfrac":
        return f"{wrap(parts[0])}/{wrap(parts[1])}"
    if n in ("msup", "mover"):
        return f"{parts[0]}^{wrap(parts[1])}"
    if n in ("msub", "munder"):
        return f"{parts[0]}_{wrap(parts[1])}"
    if n == "msubsup":
        return f"{parts[0]}_{wrap(parts[1])}^{wrap(parts[2])}"
    if n == "msqrt":
        return f"sqrt({''.join(parts)})"
    if n == "mroot":
        return f"root({parts[0]}, {parts[1]})"
    if n == "mfenced":
        return f"({', '.join(parts)})"
    if n == "mtable":
        return "[" + "; ".join(parts) + "]"
    if n == "mtr":
        return ", ".join(parts)
    return "" if n in ("annotation", "annotation-xml", "mspace") else "".join(parts)


def mathml(data: bytes) -> Iterator[tuple]:
    root = rooted(data, "math")
    yield "Formula", linear(root), None
    for kind, n in sorted(Counter(name(e) for e in root.iter() if e is not root).items()):
        yield "Element", kind, n


def xmp(data: bytes) -> Iterator[tuple]:
    root = rooted(data, "xmpmeta", "RDF")
    yield "Packet", name(root), attr(root, "xmptk")
    for d in every(root, "Description"):
        for k, v in sorted(d.attrib.items()):
            if not k.endswith("about") and "}" in k:
                yield "Property", k.rpartition("}")[2], v
        for p in d:
            items = [said(x) for x in every(p, "li")]
            yield "Property", name(p), joined(items, "; ") or said(p)


COLUMNS = ("kind", "value", "detail")
FORMATS = {k: Format(COLUMNS, counted(roots, kinds), tuple(SUFFIXES[k].split()), root_is(*roots.split()) if roots and k not in ("cellml", "iso20022", "wadl", "ocel-xml", "xpdl", "xsl-fo", "biopax", "pvd") else None) for k, (roots, kinds) in KINDS.items()} | {
    "iso19115": Format(COLUMNS, iso19115, (".iso19115.xml", ".iso.xml"), root_is("MD_Metadata", "MI_Metadata")),
    "ubl": Format(COLUMNS, ubl, (".ubl", ".ubl.xml"), lambda h: b"names:specification:ubl:schema" in h),
    "fhir-xml": Format(COLUMNS, fhir_xml, (".fhir.xml",), lambda h: b'"http://hl7.org/fhir"' in h),
    "citygml": Format(("kind", "objects", "geometry", "lod_breakdown"), citygml, (".citygml", ".city.gml"), root_is("CityModel")),
    "mathml": Format(COLUMNS, mathml, (".mml", ".mathml"), root_is("math")),
    "xmp": Format(COLUMNS, xmp, (".xmp",), root_is("xmpmeta")),
}
