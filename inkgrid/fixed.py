"""Fixed values of the domain.

Everything here must equal what users of the documents and of the exported
files already rely on: document kinds, states, limits, texts shown to people,
colours, printed column titles, month names and total labels.
"""

# --- document kinds, states, word sources --------------------------------
TIMECARD = "cartao-ponto"
PAYSLIP = "holerite"
PROCESSING = "processando"
DONE = "concluido"
FAILED = "erro"
NATIVE = "texto_nativo"
OCR = "ocr"

# --- limits ---------------------------------------------------------------
MAX_BYTES = 20 * 1024 * 1024
MAX_PAGES = 50
RETENTION_HOURS = 24
MIN_WORDS_TEXT_LAYER = 40
OCR_DPI = 300
POINTS_PER_INCH = 72.0
TITLE_THRESHOLD = 0.7
MONTH_THRESHOLD = 0.75
MAX_COLUMN_WIDTH = 40

# --- intake and lifecycle texts -------------------------------------------
SIGNATURE = "%PDF-"
MSG_TOO_LARGE = "O arquivo excede o tamanho máximo permitido de {mb} MB."
MSG_EMPTY = "O arquivo enviado está vazio."
MSG_NOT_PDF = "O arquivo enviado não é um PDF válido."
MSG_UNREADABLE = "O PDF está corrompido ou não pôde ser aberto."
MSG_NO_PAGES = "O PDF não contém páginas."
MSG_TOO_MANY_PAGES = "O PDF tem {pages} páginas e o limite é {limit}."
MSG_UNKNOWN_LAYOUT = "Não foi possível reconhecer o layout deste documento."
MSG_FAILURE = "Não foi possível processar este documento."
MSG_NOT_FOUND = "Transcrição não encontrada."
MSG_STILL_PROCESSING = "A transcrição ainda está sendo processada."

# --- findings: code, message, severity ------------------------------------
YELLOW = "amarelo"
RED = "vermelho"
ODD_PUNCHES = (
    "batidas_impares",
    "Número ímpar de batidas: falta uma entrada ou uma saída.",
    YELLOW,
)
DATE_BREAK = (
    "data_nao_sequencial",
    "A data quebra a sequência do documento, o que costuma indicar erro de leitura.",
    RED,
)
EMPTY_PAGE = (
    "pagina_vazia",
    "A página existe no PDF mas nenhum dado foi extraído dela.",
    YELLOW,
)
MONTH_BREAK = (
    "mes_nao_sequencial",
    "A competência não é o mês seguinte ao da página anterior.",
    RED,
)
UNCERTAIN = (
    "leitura_incerta",
    "Algum caractere desta linha não pôde ser lido com segurança.",
    YELLOW,
)

# --- sheet style ----------------------------------------------------------
FILL_YELLOW = "FFF3CD"
FILL_RED = "F8D7DA"
BORDER_RED = "DC3545"
FILL_HEADER = "173772"
FONT_HEADER = "FFFFFF"

# --- sheet headers --------------------------------------------------------
HEAD_DATE = "Data"
HEAD_IN = "Entrada"
HEAD_OUT = "Saída"
HEAD_PAGE, HEAD_MONTH, HEAD_YEAR = "Pág.", "Mês", "Ano"

# --- printed titles of each layout ----------------------------------------
TITLES_CONTINUATION = ("Dia", "Semana", "Jornada", "Entrada", "Saida", "Ocorrencia", "Qtde")
TITLES_TABULAR = (
    "Data", "Ent1", "Sai1", "Ent2", "Sai2", "Ent3", "Sai3", "Ent4", "Sai4",
    "H.Ext", "Atraso", "Falta", "Ad.Not", "Abono",
)
TITLES_INTERVAL = ("Dia", "Entrada", "Saida", "Intervalo", "Intervalo", "Intervalo", "ATN")
TITLES_MONTHLY = ("Cod.", "Descrição", "Unidade", "Proventos", "Descontos")
TITLES_RECEIPT = ("Descrição", "Qtde", "Valor", "Descrição", "Qtde", "Valor")
TITLES_BLOCKS = ("Verba", "Nome", "Base", "Valor")
WORDS_BLOCKS = ("verba", "nome", "valor")

# --- fingerprints, looked for in accent-free lower case -------------------
PRINT_CONTINUATION = "sipon"
PRINT_TABULAR = "cartao de ponto"
PRINT_INTERVAL = "relatorio mensal"
PRINT_MONTHLY = "periodo"
PRINT_RECEIPT = "recibo de pagamento"
PRINT_BLOCKS = "declaracao remuneracao"
PRINT_LEDGER = "fichafinanceira"
MARK_MONTH_YEAR = "mes/ano"
MARK_MONTH = "mes:"
MARK_SHEET = "folha"
MARK_TOTAL = "total"
MARK_NET = "liquido"
TOTAL_PREFIXES = ("tot.", "total")
TOTALS = (
    ("total de proventos", "TOTAL DE PROVENTOS"),
    ("total de descontos", "TOTAL DE DESCONTOS"),
    ("liquido a receber", "LÍQUIDO A RECEBER"),
)

# --- month names, calendar order ------------------------------------------
MONTH_NAMES = (
    "janeiro", "fevereiro", "marco", "abril", "maio", "junho",
    "julho", "agosto", "setembro", "outubro", "novembro", "dezembro",
)
MONTH_ABBREVIATIONS = (
    "jan", "fev", "mar", "abr", "mai", "jun",
    "jul", "ago", "set", "out", "nov", "dez",
)

# --- token shapes ---------------------------------------------------------
MONEY = r"^-?[0-9]{1,3}(\.[0-9]{3})*,[0-9]{2}$"
MONEY_MIN_DIGIT_SHARE = 0.6
CODE3 = r"^[0-9]{3}$"
FULL_DATE = r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"
DATE_SHAPE = r"^[0-9]+/[0-9]+/[0-9]+$"
REFERENCE = r"^[0-9]+([.,][0-9]+)?$"
GLUED_CODE = r"^([0-9]{1,3})([A-Za-zÀ-ÿ].*)$"
MONTH_ABBREVIATED = r"(?iu)([a-zç]{3})\s*[-/]\s*([0-9]{2,4})"
MONTH_ONE_OR_TWO = r"([0-9]{1,2})\s*/\s*([0-9]{4})"
MONTH_TWO = r"([0-9]{2})\s*/\s*([0-9]{4})"
DASHES = "[-–—]"
