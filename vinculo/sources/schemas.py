"""Explicit schemas; nothing is inferred from files."""

from pyspark.sql.types import StructType

PAGES = "file_id string, file_name string, file_ord int, kind string, page_no int, text string"
PAGE_VERSIONS = "file_id string, page_no int, stage string, text string, timed_out boolean"
TEXT_ITEMS = "file_id string, page_no int, seq int, x double, y double, h double, str string"
ANNOTATIONS = "file_id string, page_no int, seq int, contents string, field_value string, alternative_text string"
CELLS = "file string, sheet_ord int, sheet string, r int, c int, value string, num double"
MERGES = "file string, sheet_ord int, r0 int, c0 int, r1 int, c1 int"

MONEY = "decimal(18,2)"
EMPLOYEE_RECORDS = (
    "file string, row_ord long, empresa string, cidade string, contrato string, colaborador string, banco string, "
    "tipo string, total_funcionarios int, observacoes string, codigo string, "
    + ", ".join(
        f"{c} {MONEY}"
        for c in ("salario", "outros_proventos", "salario_familia", "inss", "irrf", "outros_descontos", "liquido", "fgts")
    )
)
REGISTRY = {
    "empresas": "id string, nome string, nome_normalizado string, created_at timestamp, updated_at timestamp",
    "municipios": "id string, nome string, nome_normalizado string, created_at timestamp",
    "funcionarios": (
        "id string, empresa_id string, municipio_id string, nome string, nome_normalizado string, cargo string, "
        "banco string, contrato string, codigo string, observacoes string, ativo boolean, created_at timestamp, "
        "updated_at timestamp"
    ),
    "funcionarios_salario": (
        f"funcionario_id string, salario {MONEY}, outros_proventos {MONEY}, salario_familia {MONEY}, inss {MONEY}, "
        f"irrf {MONEY}, outros_descontos {MONEY}, liquido {MONEY}, fgts {MONEY}"
    ),
    "excel_upload_history": (
        "id string, file_name string, uploaded_at timestamp, total_empresas int, total_municipios int, "
        "total_funcionarios int, funcionarios_novos int, funcionarios_atualizados int, funcionarios_removidos int"
    ),
    "processing_history": (
        "id string, user_id string, created_at timestamp, pdf_count int, duration_seconds int, month int, year int, "
        "month_name string, misses int, unprocessed_data string"
    ),
    "user_roles": "user_id string, role string",
    "profiles": "user_id string, full_name string, created_at timestamp",
    "ip_whitelist": "ip string, description string, active boolean, created_at timestamp",
}
MISSES_JSON = (
    "array<struct<name:string,reason:string,closestCandidate:string,foundInFullText:boolean,foundAsFavorecido:boolean>>"
)
ROLES = ("admin", "employee", "financeiro")


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
