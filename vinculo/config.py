"""Parameters of every operator, with their default values.

Each group below is plain data. Pass a changed copy (``dataclasses.replace``)
to an operator to use other labels, word lists or thresholds.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Name words
# ---------------------------------------------------------------------------
PARTICLES = ("DE", "DA", "DO", "DOS", "DAS", "DEL")

COMMON_SURNAMES = (
    "SILVA", "SANTOS", "OLIVEIRA", "SOUZA", "SOUSA", "RODRIGUES", "FERREIRA",
    "ALVES", "PEREIRA", "LIMA", "GOMES", "COSTA", "RIBEIRO", "MARTINS",
    "CARVALHO", "ARAUJO", "MELO", "BARBOSA", "CARDOSO", "NASCIMENTO",
    "MOREIRA", "NUNES", "MARQUES", "MACHADO", "MENDES", "FREITAS",
    "DIAS", "TEIXEIRA", "ANDRADE", "VIEIRA", "MONTEIRO", "MOURA",
    "CAVALCANTE", "CORREIA", "CORREA", "LOPES", "ROSA", "JESUS",
)

# ---------------------------------------------------------------------------
# Pay-slip page
# ---------------------------------------------------------------------------
NON_NAME_WORDS = (
    "CNPJ", "CPF", "CARGO", "FUNCAO", "ADMISSAO", "SALARIO", "EMPRESA",
    "LTDA", "EIRELI", "SA", "PRESTADORA", "SERVICOS", "FOLHA", "MENSAL",
    "RECIBO", "PAGAMENTO", "CODIGO", "NOME", "FUNCIONARIO", "DEPARTAMENTO",
    "FILIAL", "MATRICULA", "DATA", "REFERENCIA", "VENCIMENTOS", "DESCONTOS",
    "LIQUIDO", "VALOR", "TOTAL", "BASE", "FGTS", "INSS", "IRRF", "DESCRICAO",
    "OBSERVACAO", "PERIODO", "COMPETENCIA", "CBO", "CC", "FAR",
    "NOMEDOFUNCIONARIO", "NOMEFUNCIONARIO",
    "JANEIRO", "FEVEREIRO", "MARCO", "ABRIL", "MAIO", "JUNHO",
    "JULHO", "AGOSTO", "SETEMBRO", "OUTUBRO", "NOVEMBRO", "DEZEMBRO",
    "SEMESTRE", "TRIMESTRE", "BIMESTRE", "QUINZENA", "MENSALISTA", "HORISTA",
    "COMUNICADO", "DESCONTO", "EMPRESTIMO", "AVISO", "INFORMATIVO",
)
LEADING_PREPOSITIONS = (
    "DE", "DA", "DO", "DAS", "DOS", "EM", "NO", "NA", "AO", "AS", "OS",
    "POR", "ATE", "COM", "SEM", "SOB",
)

_MONTHS = "JANEIRO|FEVEREIRO|MARCO|ABRIL|MAIO|JUNHO|JULHO|AGOSTO|SETEMBRO|OUTUBRO|NOVEMBRO|DEZEMBRO"
_ROLES_AFTER_CODE = (
    "COZINHEIRA|SERVENTE|AJUDANTE|AUXILIAR|SUPERVISOR|OPERADOR|TECNICO|LIDER|ENCARREGADO|FISCAL|"
    "PORTEIRO|ZELADOR|JARDINEIRO|MOTORISTA|VIGILANTE|RECEPCIONISTA|COPEIRA|LAVADOR|PEDREIRO|PINTOR|"
    "ELETRICISTA|BOMBEIRO|MECANICO|ALMOXARIFE"
)
_ROLES_AFTER_NAME = (
    "SUPERVISOR|ANALISTA|AUXILIAR|GERENTE|COORDENADOR|ASSISTENTE|OPERADOR|TECNICO|ADMINISTRATIVO|"
    "COZINHEIRA|SERVENTE"
)
_FIELD_AFTER_NAME = r"(?= *(?:CPF|CARGO|FUNCAO|ADMISSAO|CNPJ|MATRICULA|\d{3}\.\d{3}|\z))"

# The name patterns in rank order. The page text holds single blanks as its
# only white space, so a blank stands for any white space here; word bounds
# are spelled out because Java's \b also looks at letters outside ASCII.
# Each entry: (pattern, what the text must hold for it: one of some words, a cheaper pattern, or '').
SLIP_NAME_PATTERNS = (
    (r"NOME +DO +FUNCIONARIO +CBO +(?:DEPARTAMENTO +)?(?:FILIAL +)?\d{1,5} +"
     r"((?:[A-Z]{2,15} +){1,6}[A-Z]{2,15}) +S?\d{4,6}", ("FUNCIONARIO",)),
    (r"(?<![A-Za-z0-9_])(?=[A-Z0-9]*\d)[A-Z0-9]{1,5} +([A-Z][A-Z ]{5,55}?) +"
     r"(?:" + _ROLES_AFTER_CODE + r"|S?\d{4,6})(?![A-Za-z0-9_])", r"\d"),
    (r"(?:" + _MONTHS + r") +DE +\d{4} +(?:[^ ]{1,6} +)?([A-Z][A-Z ]{5,55}?) +(?:S?\d{4,6}) ",
     tuple(_MONTHS.split("|"))),
    (r"([A-Z][A-Z ]{8,60}?) +(?:" + _ROLES_AFTER_NAME + r")", tuple(_ROLES_AFTER_NAME.split("|"))),
    (r"NOME +D[OA] +(?:FUNCIONARIO|EMPREGADO|COLABORADOR|TRABALHADOR) *:? *([A-Z][A-Z ]{4,65}?)"
     + _FIELD_AFTER_NAME, ("NOME",)),
    (r"(?:NOME|FUNCIONARIO|EMPREGADO|COLABORADOR|TRABALHADOR|TITULAR|SEGURADO|BENEFICIARIO) *:? *"
     r"([A-Z][A-Z ]{4,65}?)" + _FIELD_AFTER_NAME,
     ("NOME", "FUNCIONARIO", "EMPREGADO", "COLABORADOR", "TRABALHADOR", "TITULAR", "SEGURADO", "BENEFICIARIO")),
    (r"RECIBO +DE +PAGAMENTO[^A-Z]*([A-Z][A-Z ]{5,60}?)(?= *(?:CPF|CARGO))", ("RECIBO",)),
    (r"RECIBO[^A-Z]{0,20}([A-Z][A-Z ]{5,60}?)" + _FIELD_AFTER_NAME, ("RECIBO",)),
    (r"FAVORECIDO *:? *([A-Z][A-Z ]{5,60}?)(?= *(?:CPF|CNPJ|AG|AGENCIA|CONTA|\d{3}))", ("FAVORECIDO",)),
    (r"([A-Z][A-Z ]{5,60}?) *\d{3}[. ]?\d{3}[. ]?\d{3}[-. ]?\d{2}",
     r"[A-Z ]{5}\d{3}[. ]?\d{3}[. ]?\d{3}[-. ]?\d{2}"),
    (r"(?<![A-Za-z0-9_])([A-Z]{3,15}(?: +[A-Z]{2,15}){1,4})(?![A-Za-z0-9_])", ""),
    (r"\A([A-Z][A-Z ]{8,60})\z", ""),
)

# Patterns that mark a page as a pay slip even when no name is read from it.
SLIP_PAGE_PATTERN = (
    r"(?:NOME|FUNCIONARIO|EMPREGADO|COLABORADOR|TRABALHADOR|TITULAR)"
    r"|RECIBO\s+DE\s+PAGAMENTO"
    r"|(?<![A-Za-z0-9_])\d{3,5}\s+[A-Z][A-Z\s]{5,55}?\s+(?:COZINHEIRA|SERVENTE|AJUDANTE|AUXILIAR|\d{5,6})(?![A-Za-z0-9_])"
)

# ---------------------------------------------------------------------------
# Receipt page
# ---------------------------------------------------------------------------
PAYEE_LABELS = (
    "FAVORECIDO", "BENEFICIARIO", "DESTINATARIO", "CREDITADO", "TITULAR",
    "TITULAR DA CONTA", "RECEBEDOR", "NOME COMPLETO", "NOME DO BENEFICIARIO",
    "NOME DO FAVORECIDO", "NOME BENEFICIARIO", "NOME FAVORECIDO",
    "NOME DESTINATARIO", "NOME DO DESTINATARIO", "NOME DO CREDITADO",
    "NOME DO RECEBEDOR", "NOME DO TITULAR",
)
PAYEE_ANCHORS = (
    "CPF", "CNPJ", "AG[E ]*NCIA", "AGENCIA", "CONTA", "BANCO", "VALOR",
    "COOPERATIVA", "DATA", "MODALIDADE", "CODIGO", "NUMERO", "TIPO",
    "CREDITO", "DEBITO", "PAGAMENTO", "TRANSFERENCIA", "PIX", "TED", "DOC",
    "CHAVE", "INSTITUICAO", "COMP", "RECIBO", "TRANSF", r"R\$", "BRL",
    r"\d{3}[. ]?\d{3}[. ]?\d{3}", r"\d{2}/\d{2}", r"\z",
)
PAYEE_FALLBACK_LABELS = (
    "NOME DO FAVORECIDO", "NOME DO BENEFICIARIO", "NOME FAVORECIDO",
    "NOME BENEFICIARIO", "FAVORECIDO", "BENEFICIARIO", "DESTINATARIO",
    "CREDITADO", "TITULAR DA CONTA", "TITULAR", "RECEBEDOR", "NOME COMPLETO",
    "NOME DO CREDITADO", "NOME DO RECEBEDOR", "NOME DO TITULAR",
)
PAYEE_STOP_WORDS = (
    "CPF", "CNPJ", "AGENCIA", "CONTA", "BANCO", "VALOR", "COOPERATIVA",
    "DATA", "MODALIDADE", "CODIGO", "NUMERO", "TIPO", "CREDITO", "DEBITO",
    "PAGAMENTO", "TRANSFERENCIA", "PIX", "TED", "DOC", "CHAVE",
    "INSTITUICAO", "AG", "SICREDI", "BRADESCO", "ITAU", "SANTANDER",
    "CAIXA", "BB",
)

# ---------------------------------------------------------------------------
# Roster grids
# ---------------------------------------------------------------------------
REQUIRED_HEADERS = ("EMPRESA", "CIDADE", "CONTRATO", "COLABORADOR", "BANCO")

ROSTER_ALIASES = {
    "empresa": ("EMPRESA", "EMPRESA CONVENIADA", "RAZAO SOCIAL", "COMPANY"),
    "cidade": ("CIDADE", "MUNICIPIO", "LOCALIDADE", "CITY"),
    "contrato": ("CONTRATO", "NUMERO CONTRATO", "CONTRACT"),
    "colaborador": ("COLABORADOR", "FUNCIONARIO", "NOME", "EMPREGADO", "NOME FUNCIONARIO"),
    "total_funcionarios": ("TOTAL FUNCIONARIOS", "TOTAL FUNC", "QTD FUNCIONARIOS"),
    "banco": ("BANCO", "INSTITUICAO", "BANK"),
    "tipo": ("TIPO", "MODALIDADE", "TYPE"),
    "observacoes": ("OBSERVACOES", "OBSERVAÇÕES", "OBS", "OBSERVACAO", "OBSERVAÇÃO"),
    "salario": ("SALARIO", "SALÁRIO", "SAL", "REMUNERACAO", "REMUNERAÇÃO", "VALOR"),
}
PAYROLL_ALIASES = {
    "codigo": ("CODIGO", "CÓDIGO", "COD", "COD.", "MATR", "MATRICULA", "MATRÍCULA"),
    "nome": ("NOME DO EMPREGADO", "NOME EMPREGADO", "NOME", "EMPREGADO", "FUNCIONARIO", "FUNCIONÁRIO",
             "COLABORADOR"),
    "salario": ("SALARIO", "SALÁRIO", "SAL", "SAL.", "SALARIO BASE", "SALÁRIO BASE", "REMUNERACAO",
                "REMUNERAÇÃO"),
    "outros_proventos": ("OUT.PROV", "OUTROS PROVENTOS", "OUT PROV", "OUTPROV", "OUTROS PROV", "OUT. PROV",
                         "O.PROV"),
    "salario_familia": ("SAL.FAM", "SALARIO FAMILIA", "SAL FAM", "SALFAM", "SALÁRIO FAMÍLIA", "SAL. FAM",
                        "S.FAM"),
    "inss": ("INSS", "PREV.SOCIAL", "PREV SOCIAL"),
    "irrf": ("IRRF", "IR", "IMPOSTO RENDA"),
    "outros_descontos": ("OUT.DES", "OUTROS DESCONTOS", "OUT DES", "OUTDES", "OUTROS DESC", "OUT. DES",
                         "O.DESC"),
    "liquido": ("LIQUID", "LÍQUID", "LIQUIDO", "LÍQUIDO", "LIQ", "LÍQ", "VALOR LIQUIDO", "VALOR LÍQUIDO"),
    "fgts": ("FGTS", "F.G.T.S"),
}
PAYROLL_MONEY_FIELDS = (
    "salario", "outros_proventos", "salario_familia", "inss", "irrf", "outros_descontos", "liquido", "fgts",
)

CITY_LINE_SUFFIXES = (
    "ITAU", "SICREDI", "PREFEITURA", "BRADESCO", "CAIXA", r"BB(?![A-Za-z0-9_])", "SANTANDER", "BANRISUL",
    "LIMPEZA", "PORTEIRO", "COZINHA", "VIGILANCIA", "MANUTENCAO",
)
COMPANY_PREFIXES = ("B SERVICE", "SPACE", "FORTCLEAN", "INTERCLEAN")
COMPANY_KEYWORDS = (
    "EIRELI", "LTDA", "SERVICOS EIRELI", "PRESTADORA", "S/A", "S.A.", " ME", " EPP", " MEI", "ASSESSORIA",
    "CONSULTORIA",
)
INSTITUTION_PREFIXES = (
    "IPAM", "IFRS", "SESI", "MIN AGRIC", "MINISTERIO", "FARMACIA", "METROPOLITANA", "SS CAI",
)
MUNICIPAL_WORDS = ("MUNICIPIO", "PREFEITURA", r"CAMARA\s+MUNICIPAL", r"PACO\s+MUNICIPAL")
CITY_SHEET_SKIP_VALUES = (
    "", "NOME", "FUNCIONARIO", "COLABORADOR", "MATRICULA", "CODIGO", "EMPRESA", "CIDADE", "TOTAL",
    "SUBTOTAL", "SOMA",
)
PAYROLL_SKIP_PATTERN = (
    r"(?iu)^(?:TOTAL|SUBTOTAL|SOMA|RELAC|COMPETENCIA|PAGAMENTO|SERVI[ÇC]O|EMPRESA|CNPJ|CODIGO|NOME)"
)
SECTION_TYPES = (
    (r"(?iu)^EMPREGADOS?\s*$", "Empregados"),
    (r"(?iu)^CONTRIBUINTES?\s*$", "Contribuintes"),
    (r"(?iu)^AUTONOMOS?\s*$", "Autônomos"),
    (r"(?iu)^ESTAGIARIOS?\s*$", "Estagiários"),
)

# ---------------------------------------------------------------------------
# texts
# ---------------------------------------------------------------------------
MONTH_NAMES = (
    "Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho",
    "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro",
)
REASON_AS_PAYEE = "FAVORECIDO encontrado mas matchNameDirect rejeitou (divergência primeiro/último nome)"
REASON_IN_TEXT = "Nome está no texto do comprovante mas NÃO foi extraído como FAVORECIDO/BENEFICIÁRIO"
REASON_NONE = "Nenhum FAVORECIDO/BENEFICIÁRIO similar encontrado nos comprovantes"
CATEGORY_AS_PAYEE = "FAVORECIDO encontrado mas rejeitado pelo matching"
CATEGORY_IN_TEXT = "Nome no texto mas não extraído como FAVORECIDO"
CATEGORY_CANDIDATE = "Nome ausente - candidato parcial encontrado"
CATEGORY_NONE = "Nome completamente ausente dos comprovantes"
BADGE_AS_PAYEE = "Match rejeitado"
BADGE_IN_TEXT = "Não extraído como FAVORECIDO"
BADGE_CANDIDATE = "Candidato parcial"
BADGE_NONE = "Ausente"
NO_CANDIDATE = "(nenhum)"
MISSES_CSV_HEADER = (
    "Nome", "Normalizado", "Arquivo", "Página", "No Texto", "FAVORECIDO", "Candidato Próximo", "Motivo",
)


@dataclass(frozen=True)
class MatchConfig:
    """Thresholds of the name score and of the four match methods."""

    accept: float = 0.85            # payee score that counts as a sure hit
    relaxed: float = 0.78           # payee score accepted because a label gives context
    partial: float = 0.70           # lower bound of the "partial candidate" text
    first_name_similarity: float = 0.85
    first_name_edits: int = 2
    surname_edits: int = 1
    common_only_cap: float = 0.75
    ends_match_floor: float = 0.87
    distinctive_bonus: float = 0.05
    no_shared_surname: float = 0.1
    substring_min_chars: int = 8
    substring_score: float = 0.8
    overlap_ratio: float = 0.7
    overlap_score: float = 0.6
    proximity_chars: int = 100
    proximity_score: float = 0.5
    review_below: float = 0.8
    particles: tuple[str, ...] = PARTICLES
    common_surnames: tuple[str, ...] = COMMON_SURNAMES
    # Most candidate pairs that one hash cell of a blocked join may hold.
    pairs_per_cell: int = 4_000_000


@dataclass(frozen=True)
class TextConfig:
    """Text-length limits used when choosing between versions of a page."""

    native_min_chars: int = 100
    short_chars: int = 40
    slip_retry_chars: int = 60
    text_page_chars: int = 50


MATCH = MatchConfig()
TEXT = TextConfig()
