"""Fixed values of the evidence contracts.

Everything in this file is data that results depend on byte for byte: names,
patterns, states, exit codes and the rule tables over node and edge kinds.
"""

from __future__ import annotations

# Prefix of every versioned schema id.  Ids and digests cover the schema text,
# so callers that hold bundles of another producer pass that producer's prefix.
DEFAULT_NAMESPACE = "evidence.inspection"


def schema_id(name: str, namespace: str = DEFAULT_NAMESPACE) -> str:
    return f"{namespace}.{name}"


# --- fixed values: patterns -------------------------------------------------
# \z and not $, which also matches before a last line end.
HEX64 = r"\A[0-9a-f]{64}\z"
HEX40 = r"\A[0-9a-f]{40}\z"
SIZE = r"\A(0|[1-9][0-9]*)\z"
POSITIVE_SIZE = r"\A[1-9][0-9]*\z"
TOKEN = r"\A[a-z0-9]+([._-][a-z0-9]+)*\z"
KIND = r"\A[a-z0-9]+(-[a-z0-9]+)*\z"
VERSION = r"\A[A-Za-z0-9]+([._+-][A-Za-z0-9]+)*\z"
KEY_ID = r"\A[A-Za-z0-9]+([._:+-][A-Za-z0-9]+)*\z"
SNAPSHOT_ID = r"\Asnapshot:sha256:[0-9a-f]{64}\z"
BUNDLE_ID = r"\Abundle:sha256:[0-9a-f]{64}\z"
RELEASE_TARGET = r"\Areleases/bundle:sha256:[0-9a-f]{64}\z"
RELATION_ID = r"\Acoverage-relation:sha256:[0-9a-f]{64}\z"
CHECKSUM_LINE = r"\A([0-9a-f]{64})  ([^\r\n]+)\z"
INTEGER = r"\A(0|-?[1-9][0-9]*)\z"
SAFE_INTEGER = 9007199254740991

# --- fixed values: control files and entry points ---------------------------
MANIFEST = "manifest.json"
CHECKSUMS = "checksums.sha256"
RESERVED_PATHS = (MANIFEST, CHECKSUMS)
INDEX_PATH = "navigation/index.html"
RUN_REPORT_PATH = "reports/run.json"

# --- fixed values: run report -----------------------------------------------
CLAIM_SCOPE = "mechanical-structural-and-integrity-inspection"
CLAIM_EXCLUSIONS = (
    "certification",
    "evidence-adequacy",
    "evidence-approval",
    "fitness-for-use",
    "functional-safety",
    "security",
    "software-qualification",
    "standards-compliance",
    "tool-qualification",
)
SEVERITIES = ("info", "warning", "error")
DECISIONS = ("satisfied", "blocked")
STAGE_STATES = ("succeeded", "failed", "blocked", "skipped", "degraded")
STAGE_POLICIES = ("required", "optional")

# --- fixed values: snapshot file modes --------------------------------------
FILE_MODES = (("file", "100644"), ("file", "100755"), ("symlink", "120000"))

# --- fixed values: provenance -----------------------------------------------
VERIFIED = "verified-current-snapshot"
ATTESTED = "externally-attested"
UNKNOWN = "unknown-origin"
PROVENANCE = (VERIFIED, ATTESTED, UNKNOWN)

# --- fixed values: symbol producer ------------------------------------------
SYMBOL_ADAPTER = "builtin.doxygen.v1"
SYMBOL_PAYLOAD_KIND = "doxygen-payload"
SYMBOL_STAGE = "doxygen"
COVERAGE_STAGE = "coverage"

# --- fixed values: graph kinds ----------------------------------------------
NODE_KINDS = (
    "snapshot",
    "source-file",
    "symbol",
    "api-page",
    "api-artifact",
    "coverage-report",
    "coverage-page",
    "coverage-summary",
    "coverage-sidecar",
    "producer-log",
    "stage-output",
    "stage-result",
    "rendered-navigation-artifact",
)
EDGE_KINDS = (
    "describes-snapshot",
    "generated-by-stage",
    "documents-source",
    "documents-symbol",
    "covers-source",
    "covers-symbol",
    "has-log",
    "links-to",
)
COVERAGE_KINDS = ("coverage-report", "coverage-page", "coverage-summary")
RELATION_EDGES = ("covers-source", "covers-symbol")
PRODUCER_KINDS = ("api-page", *COVERAGE_KINDS, "coverage-sidecar", "producer-log")

# edge kind -> (allowed source kinds, allowed target kinds)
EDGE_ENDPOINTS = {
    "describes-snapshot": (
        tuple(kind for kind in NODE_KINDS if kind != "snapshot"),
        ("snapshot",),
    ),
    "generated-by-stage": (
        ("api-page", "api-artifact", *COVERAGE_KINDS, "coverage-sidecar", "producer-log", "stage-output"),
        ("stage-result",),
    ),
    "documents-source": (("api-page",), ("source-file",)),
    "documents-symbol": (("api-page",), ("symbol",)),
    "covers-source": (COVERAGE_KINDS, ("source-file",)),
    "covers-symbol": (COVERAGE_KINDS, ("symbol",)),
    "has-log": (("stage-result",), ("producer-log",)),
    "links-to": (
        ("rendered-navigation-artifact",),
        tuple(kind for kind in NODE_KINDS if kind != "rendered-navigation-artifact"),
    ),
}

# node kind -> rules on its fields.  ``fields`` are the optional fields that
# carry a value; every other optional field must be null.  ``identity`` are the
# members of the committed identity object.
NODE_RULES = {
    "snapshot": {"fields": (), "prefix": None, "identity": ("snapshot_id",)},
    "source-file": {
        "fields": ("path", "sha256"),
        "prefix": "",
        "identity": ("path", "sha256", "snapshot_id"),
    },
    "stage-result": {
        "fields": ("sha256", "stage_status"),
        "prefix": None,
        "identity": ("digest", "snapshot_id", "stage", "status"),
    },
    "stage-output": {
        "fields": ("path", "sha256", "stage_status"),
        "prefix": "",
        "identity": ("kind", "path", "sha256", "size", "snapshot_id", "stage"),
    },
    "api-page": {
        "fields": ("path", "sha256", "provenance"),
        "prefix": "artifacts/api/",
        "identity": ("adapter", "artifact_id", "path", "provenance", "sha256", "snapshot_id"),
    },
    "api-artifact": {
        "fields": ("path", "sha256", "provenance"),
        "prefix": "artifacts/api/",
        "identity": ("adapter", "artifact_id", "kind", "path", "provenance", "sha256", "snapshot_id"),
    },
    "symbol": {
        "fields": ("path", "fragment"),
        "prefix": None,
        "identity": (
            "adapter", "column", "entity_kind", "fragment", "html_artifact_id", "label",
            "line", "path", "refid", "snapshot_id", "source_path",
        ),
    },
    "coverage-report": {
        "fields": ("path", "sha256", "provenance"),
        "prefix": "artifacts/coverage/",
        "identity": (
            "adapter_schema", "artifact_id", "entry_point", "path", "provenance",
            "report_entry_point", "report_tree_sha256", "sha256", "snapshot_id",
        ),
    },
    "coverage-page": {
        "fields": ("path", "sha256", "provenance"),
        "prefix": "artifacts/coverage/",
        "identity": (
            "adapter_schema", "artifact_id", "entry_point", "path", "provenance",
            "report_entry_point", "report_tree_sha256", "sha256", "snapshot_id",
        ),
    },
    "coverage-summary": {
        "fields": ("path", "sha256", "provenance"),
        "prefix": "artifacts/coverage/",
        "identity": (
            "adapter_schema", "artifact_id", "entry_point", "path", "provenance",
            "report_entry_point", "report_tree_sha256", "sha256", "snapshot_id",
        ),
    },
    "coverage-sidecar": {
        "fields": ("path", "sha256"),
        "prefix": "artifacts/coverage-sidecars/",
        "identity": ("artifact_id", "kind", "path", "sha256", "size", "snapshot_id", "source_path"),
    },
    "producer-log": {
        "fields": ("path", "sha256"),
        "prefix": "artifacts/logs/",
        "identity": ("path", "sha256", "size", "snapshot_id", "stage", "stage_node_id"),
    },
    "rendered-navigation-artifact": {
        "fields": ("path", "sha256"),
        "prefix": "",
        "identity": ("base_graph_id", "path", "sha256", "size", "snapshot_id"),
    },
}

# --- fixed values: publication states and exit codes ------------------------
PUBLICATION_EXIT = {
    "not-attempted": 10,
    "definite-pre-commit-failure": 11,
    "commit-indeterminate": 12,
    "durable-success": 0,
    "recovered-durable-success": 0,
    "recovered-no-commit": 13,
    "recovery-blocked": 14,
}

# --- fixed values: navigation sections, in page order -----------------------
NAVIGATION_SECTIONS = (
    ("api", ("api-page", "api-artifact")),
    ("sources", ("source-file",)),
    ("symbols", ("symbol",)),
    ("coverage", COVERAGE_KINDS),
    ("logs", ("producer-log",)),
    ("sidecars", ("coverage-sidecar",)),
    ("outputs", ("stage-output",)),
    ("stages", ("stage-result",)),
)

# --- fixed values: redaction ------------------------------------------------
REDACTED = "<redacted>"

# --- fixed values: signature envelope ---------------------------------------
ENVELOPE_KEYS = ("algorithm", "binding", "key_id", "public_key", "schema", "signature")
BINDING_KEYS = ("bundle_id", "checksums_sha256", "manifest_sha256", "payload_sha256", "statement_type")
SIGNATURE_ALGORITHM = "ed25519"
