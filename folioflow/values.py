"""Word lists, tables, patterns and constants on which results depend. They are stated as they have to be."""

# fixed values: file kinds
PDF_TYPES = ("pdf",)
IMAGE_TYPES = ("png", "jpg", "jpeg", "tiff", "tif", "bmp")
STRUCTURED_TYPES = ("xlsx", "xlsm", "xls", "xlsb", "doc", "docx", "msg")
SUPPORTED_TYPES = PDF_TYPES + IMAGE_TYPES + STRUCTURED_TYPES
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
BATCH_KEY_PATTERN = r"^BATCH-\d{8}-\d{6}-[a-f0-9]{6}$"

# fixed values: columns that track a manifest row through its batch
TRACKING = (
    ("tracking_status", "string"), ("batch_key", "string"), ("batch_document_id", "bigint"), ("stored_filename", "string"), ("saved_path", "string"),
    ("prepared_at", "string"), ("batch_status", "string"), ("document_status", "string"), ("finalized_at", "string"), ("route", "string"),
    ("processing_route", "string"), ("rfc", "string"), ("fecha_documento", "string"), ("tipo_documento", "string"), ("nombre_proveedor", "string"),
    ("quality_score", "int"), ("quality_traffic_light", "string"), ("quality_reasons", "string"), ("error_message", "string"), ("export_xlsx_path", "string"),
)
EXPORT_COLUMNS = (
    "batch_key", "document_id", "link", "filename", "source_type", "file_size_bytes", "file_size_kb", "file_path", "mime_type", "route",
    "processing_route", "status", "rfc", "fecha_documento", "tipo_documento", "nombre_proveedor", "quality_score", "quality_traffic_light",
    "quality_reasons", "error_message",
)

# fixed values: quality weights, confidences and limits
WEIGHTS = {"rfc": 35, "fecha_documento": 30, "tipo_documento": 20, "nombre_proveedor": 15}
GREEN_MIN, YELLOW_MIN = 85, 65
RFC_FORMAT = r"^[A-ZÑ&]{3,4}\d{6}[A-Z0-9]{3}$"
FOREIGN_FORMAT = r"^\d{2}-\d{7}$"
DATE_FORMAT = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"
DATE_MIN_YEAR, DATE_YEARS_AHEAD, NAME_MIN_LENGTH = 1990, 1, 3
DEFAULT_TYPE = "Documentos Varios"

# fixed values: tax identifier alphabet in order of value, and OCR confusions
TAX_ALPHABET = "0123456789ABCDEFGHIJKLMN&OPQRSTUVWXYZÑ"
OCR_DIGITS_FROM, OCR_DIGITS_TO = "OISBGZDl", "01586201"
OCR_HINT_FROM, OCR_HINT_TO = "OISB", "0158"
SKIPPED_GIVEN_NAMES = ("JOSE", "JO", "J", "MARIA", "MA", "MA.")
TAIL_CONFUSIONS = {
    "0": "0OQD", "O": "O0QD", "Q": "Q0O", "1": "1IL", "I": "I1L", "L": "L1I", ")": "L1I9", "9": "9L1I", "5": "5S", "S": "S58", "8": "8B", "B": "B8",
    "6": "6G", "G": "G6", "2": "2Z", "Z": "Z2", "7": "7T", "T": "T7",
}
IGNORED_TAX_IDS = ("CCO8605231N4",)

# fixed values: mojibake of Spanish letters and its repair, accents
MOJIBAKE = (("ÃƒÂ³", "o"), ("ÃƒÂ¡", "a"), ("ÃƒÂ©", "e"), ("ÃƒÂ­", "i"), ("ÃƒÂº", "u"), ("ÃƒÂ±", "n"))
ACCENTED, PLAIN = "áéíóúÁÉÍÓÚñÑ", "aeiouAEIOUnN"
EVAL_ACCENTED, EVAL_PLAIN = "áéíóúÁÉÍÓÚñÑàèìòùÀÈÌÒÙäëïöüÄËÏÖÜ", "aeiouAEIOUnNaeiouAEIOUaeiouAEIOU"

# fixed values: classification of pages
PAGE_MIN_CHARS, PAGE_MIN_RATIO, PAGE_MIN_WORDS, DIGITAL_SHARE, DIGITAL_MIN_CHARS, SAMPLED_PAGES = 150, 0.5, 10, 0.6, 300, 5
OCR_KEYWORDS = ("convenio", "proveedor", "cliente", "razon social", "rfc", "fecha", "firma", "domicilio", "femsa", "oxxo", "pagina")

# fixed values: months
MONTHS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9,
    "octubre": 10, "noviembre": 11, "diciembre": 12,
}
MONTH_ABBREVIATIONS = {"ene": 1, "feb": 2, "mar": 3, "abr": 4, "may": 5, "jun": 6, "jul": 7, "ago": 8, "sep": 9, "set": 9, "oct": 10, "nov": 11, "dic": 12}

# fixed values: date hints in OCR text, in lower case without accents; MONTHS stands for the names of months, joined by bars
DATE_HINTS = (
    r"(siendo\s+el\s+dia[\s\._:-]*[0-9oils]{1,2}[\s\._:-]*(?:de)?[\s\._:-]*(?:MONTHS)[\s\._:-]*(?:de)?[\s\._:-]*(?:19|20)[0-9oils]{2})",
    r"\b([0-9oils]{1,2}[\s\._:-]*de[\s\._:-]*(?:MONTHS)[\s\._:-]*de[\s\._:-]*(?:19|20)[0-9oils]{2})\b",
)
DATE_HINT_YEAR, DATE_HINT_DAY, DATE_HINT_ANCHOR = r"(19|20)[0-9oils]{2}", r"\b[0-9oils]{1,2}\b", "siendo el dia"
DATE_HINT_EDGES, DATE_HINT_MIN, DATE_HINTS_KEPT = " .,:;_-", 12, 2

# fixed values: date shapes. Kind of builder, base score and pattern, in order of precedence
NUMERIC_DATES = (
    r"\b(\d{1,2}/\d{1,2}/\d{4})\b", r"\b(\d{1,2}/\d{1,2}/\d{2})\b", r"\b(\d{1,2}-\d{1,2}-\d{4})\b", r"\b(\d{1,2}-\d{1,2}-\d{2})\b",
    r"\b(\d{4}-\d{1,2}-\d{1,2})\b", r"\b(\d{1,2}\.\d{1,2}\.\d{4})\b", r"\b(\d{1,2}\.\d{1,2}\.\d{2})\b",
)
TEXTUAL_DATES = (
    ("strict", 4, r"(?i)\b(?:siendo\s+el\s+d[ií]a\s+)?(\d{1,2})\s*(?:de)?\s+([a-zA-Záéíóúñ]+)\s*(?:de)?\s+(\d{4})\b"),
    ("strict", 3, r"(?i)\b(?:siendo\s+el\s+d[ií]a\s+)?([0-9OILS]{1,2})\s*(?:de)?\s*([a-zA-Záéíóúñ]{3,15})\s*(?:de)?\s*([0-9OILS]{4})\b"),
    ("strict_number", 5, r"(?i)\b(?:siendo\s+el\s+d[ií]a\s+)?([0-9OILS]{1,2})\s*de\s*([0-9OILS]{1,2})\s*(?:de|del)\s*([0-9OILS]{4})\b"),
    ("flexible", 7, r"(?i)\b(?:siendo\s+el\s+d[ií]a\s+)?(\d{1,2})\s*(?:de)?\s+([a-zA-Záéíóúñ]+)\s*(?:de)?\s+(\d{2})\b"),
    ("flexible", 7, r"(?i)\b(?:siendo\s+el\s+d[ií]a\s+)?([0-9OILS]{1,2})\s*(?:de)?\s*([a-zA-Z0-9áéíóúñ]{3,15})\s*(?:de)?\s*([0-9OILS]{2})\b"),
    ("flexible_number", 7, r"(?i)\b(?:siendo\s+el\s+d[ií]a\s+)?([0-9OILS]{1,2})\s*de\s*([0-9OILS]{1,2})\s*(?:de|del)\s*([0-9OILS]{2})\b"),
    ("flexible", 8, r"(?i)\b([0-9OILS]{1,2})\s*[/\-\._]?\s*([a-zA-Z0-9áéíóúñ]{3,10})\s*[/\-\._]?\s*([0-9OILS]{2,4})\b"),
    ("month_first", 8, r"(?i)\b([a-zA-Záéíóúñ]{3,15})\s+([0-9OILS]{1,2})\s*,?\s+([0-9OILS]{4})\b"),
    ("month_first", 8, r"(?i)\b([a-zA-Z0-9áéíóúñ]{3,15})\s+([0-9OILS]{1,2})\s*,?\s+([0-9OILS]{2})\b"),
    ("flexible", 14, r"(?i)\b(?:a\s+los?|los?)\s+([0-9OILS]{1,2})\s+d[ií]as?\s+del\s+mes\s+de\s+([a-zA-Z0-9áéíóúñ]{3,15})\s+(?:de|del)\s+([0-9OILS]{2,4})\b"),
    ("flexible", 12, r"(?i)\b(?:siendo\s+el\s+d[ií]a\s*)?([0-9OILS]{1,2})\s*[\|\[\]!¡,.;:_-]*\s*(?:de)?\s+([a-zA-Z0-9áéíóúñ]{3,15})\s*[\|\[\]!¡,.;:_-]*\s*(?:de|del)?\s*([0-9OILS]{2}\s*[/\|\[\]!¡,.;:_-]+\s*[0-9OILS]{2})\b"),
)
NOISY_DATE = ("flexible", 7, r"(?i)\b([0-9OILS]{1,2})\s*([a-zA-Z]{3,6})[0-9OILS]?\s*([0-9OILS]{2,4})\b")
SPLIT_YEAR_TAIL = r"(?i)\s*[/\|\[\]!¡,.;:_-]+\s*[0-9OILS]{2}\b"
LEGAL_CONTEXT = (
    "ley", "leyes", "ley federal", "leyes vigentes", "gobierno", "gubernamental", "estados unidos mexicanos", "diario oficial", "federacion", "secretaria",
    "escritura publica", "instrumento publico", "fe del notario", "notario publico", "notarial", "registro publico", "registro publico de la propiedad",
    "propiedad y del comercio", "decreto", "codigo civil", "codigo de comercio", "articulo", "constitucion",
)
SIGNATURE_TERMS = ("lo firman", "firman", "firma", "firmado", "suscriben", "suscribe", "presente contrato", "contrato", "partes", "testigos", "representante legal")
SIGNATURE_TYPES = ("suministro de productos de linea en cedis", "convenio entrega local")
DATE_FLOOR = "2000-01-01"

# fixed values: tax identifier shapes in text
TAX_PLAIN = r"(?i)\b([A-ZÑ&]{3,4}\d{6}[A-Z0-9]{3})\b"
TAX_GROUPED = r"(?i)\b([A-ZÑ&]{3,4})[\s\-\._]*([0-9OIS]{2})[\s\-\._]*([0-9OIS]{2})[\s\-\._]*([0-9OIS]{2})[\s\-\._]*([A-Z0-9]{2,3})\b"
TAX_LABEL = r"(?i)\b(?:RFC|R\.?\s*F\.?\s*C\.?|REGISTRO\s+FEDERAL\s+DE\s+CONTRIBUYENTES|F\.?\s*C)\b"
TAX_BLOCK = r"(?i)\b(?:RAZ\w*\s+SOCI\w*|DOMICILIO\s+FISCAL|NOMBRE\s+DEL\s+PROVEEDOR|PROVEEDOR|TIPO\s+DE\s+PROVEEDOR)\b"
FOREIGN_LABELLED = r"(?i)\b(?:US\s+FEDERAL\s+TAX\s+ID|FEDERAL\s+TAX\s+ID|TAX\s+ID|TIN|EIN)\b[^0-9]{0,12}([0-9]{2}\s*[\-\.]?\s*[0-9]{7})\b"
FOREIGN_IN_CONTEXT = r"(?i)\bRFC\b.{0,50}\b(?:US\s+FEDERAL\s+TAX\s+ID|TAX\s+ID|TIN|EIN)\b[^0-9]{0,12}([0-9]{2}\s*[\-\.]?\s*[0-9]{7})\b"

# fixed values: supplier names
LEGAL_FORM = r"(?i)\bS\.?\s*A\.?\s*(DE\s*C\.?\s*V\.?)?\b|\bLLC\b|\bINC\b|\bLTD\b|\bCOMPANY\b"
COMPANY_END = r"(?i)\b(.+?\bS\.?\s*A\.?\s*DE\s*C\.?\s*V\.?)\b"
NAME_TAIL = r"(?i)\b(NO\.?\s*CUENTA|NUM\.?\s*CUENTA|CODIGO\s*DE\s*CLIENTE|CTA\.?|CURP|RFC)\b.*$"
NAME_BLOCKED = r"(?i)(CADENA\s+COMERCIAL\s+OXXO|FEMSA|EL\s+CLIENTE)"
NAME_PLACEHOLDER = r"(?i)\b(?:NOMBRE\s+DE\s+RAZ\w*\s+SOCI\w*|NOMBRE\s+DEL\s+PROVEEDOR|NOMBRE\s+PROVEEDOR)\b"
NAME_LINE = r"(?im)^\s*(?:RAZ[\w?]*\s+SOCI[\w?]*(?:\s+PROVEEDOR)?|PROVEEDOR|EMISOR)\s*(?:[:\-]\s*)?(.+?)\s*$"
NAME_CONTEXTS = (
    r"(?is)\bconfirma\s+su\s+acuerdo\s+con\s+(.+?)\s+a\s+quien\s+en\s+lo\s+sucesivo(?:\s+se\s+le)?(?:\s+denom\w+)?",
    r"(?is)\by\s+(.+?)\s+con\s+RFC\b.*?(?:denomina|denominara|denominado|en\s+delante\s+se\s+denomina)\s+[\*\"'“”]?\s*EL\s+PROVEEDOR",
    r"(?is)\bEL\s+CLIENTE.{0,280}?\by\s+(.+?)\s+con\s+RFC\b",
    r"(?is)\by\s+(.+?)\s+con\s+RFC\s+(?:US\s+FEDERAL\s+TAX\s+ID|TAX\s+ID|TIN|EIN)\b",
    r"(?is)\bpor\s+otra\s+parte\s+la\s+sociedad\s+mercantil\s+(.+?)(?:\s+representad[ao]|\s+a\s+quien\b|,)",
)
NAME_CUTS = (r"(?i)^.*?\bACUERDO\s+CON\s+", r"(?i)\s+CON\s+RFC\b.*$", r"(?i)\s+a\s+quien\b.*$", r"(?i)\s+representad[ao]\s+por\b.*$", NAME_TAIL)
NAME_EDGES, NAME_QUOTES = " .:-|", " .:-|*'\"”“’`_"
LEGAL_TOKENS = (
    "SA", "S", "A", "DE", "CV", "C", "V", "SACV", "SADECV", "SOCIEDAD", "ANONIMA", "ANONIMO", "COMPANIA", "COMPAIA", "COMPANY", "CIA", "LIMITADA", "LTDA", "LTD",
    "LLC", "INC", "CORP", "CORPORATION", "THE", "AND", "Y",
)
MATCH_LEADING = (
    r"(?i)^\s*confirma\s+su\s+acuerdo\s+con\s+", r"(?i)^\s*acuerdo\s+con\s+", r"(?i)^\s*por\s+otra\s+parte\s+la\s+sociedad\s+mercantil\s+",
    r"(?i)^\s*(raz[oó]n\s+social|nombre\s+del\s+proveedor|proveedor)\s*[:\-]\s*", r"(?i)^\s*y\s+",
)
MATCH_TRAILING = (r"(?i)\s+con\s+rfc\b.*$", r"(?i)\s+a\s+quien\b.*$", r"(?i)\s+representad[oa]\s+por\b.*$", r"(?i)\b(curp|cuenta|clabe|telefono|tel[eé]fono)\b.*$")
SIMILARITY = {"ratio": 0.30, "token_sort": 0.30, "token_set": 0.20, "contains": 0.10, "same_first": 0.10}
SHORT_NAME_MIN, LONG_NAME_MIN = 0.85, 0.82
LEAST_SIMILARITY = min(SHORT_NAME_MIN, LONG_NAME_MIN)
VENDOR_HEADERS = ("vendorname", "suppliername", "nombreproveedor", "nombrevendor", "proveedor", "razonsocial")
TAX_HEADERS = ("rfc", "taxid", "federaltaxid", "taxidnumber", "registrofederaldecontribuyentes")

# fixed values: path segments that are no supplier
GENERIC_SEGMENTS = (
    "AMER PRGX COM", "AMER PRGX", "PRGX", "IMAGES", "OXXOMEX", "OXXO MEX", "LINK", "LINK 2026", "PROCESO ALTAS", "PROCESO ALTA", "ALTAS", "ALTA", "SOPORTES",
    "SOPORTE", "CONTRATOS", "CONTRATO", "CONVENIOS", "CONVENIO", "CEDIS", "PROVEEDORES", "PROVEEDOR", "INCOMING", "EXPORTS", "DATA",
)
PATH_LEGAL_FORM = r"(?i)\b(?:S\.?\s*A\.?|SAPI|S\.?\s*DE\s*R\.?\s*L\.?|DE\s*C\.?\s*V\.?|C\.?\s*V\.?|LLC|INC|LTD|COMPANY|COMPANIA|CIA|CORP|CORPORATION)\b"

# fixed values: spreadsheet labels and where their values are looked for
SHEET_LABELS = {
    "RAZON SOCIAL": "Razon Social", "RAZON SOCIAL PROVEEDOR": "Razon Social Proveedor", "NOMBRE PROVEEDOR": "Proveedor", "NOMBRE DEL PROVEEDOR": "Proveedor",
    "PROVEEDOR": "Proveedor", "EMISOR": "Emisor", "RFC": "RFC", "R F C": "RFC", "REGISTRO FEDERAL DE CONTRIBUYENTES": "RFC",
}
SHEET_NOISE = ("CATEGORIA", "ELABORA", "NEGOCIO", "VIA", "FECHA", "TIPO DE NEGOCIO", "CODIGO DE BARRAS", "DESCRIPCION", "COSTO BRUTO", "COSTO NETO")
SHEET_OFFSETS = ((1, 0), (0, 1), (1, 1), (1, -1), (0, -1), (-1, 0), (-1, 1), (-1, -1), (2, 0), (0, 2), (2, 1), (1, 2))

# fixed values: document types: name, any of, all of, none of
DOCUMENT_TYPES = (
    ("Carta Anexo a Convenio Entrega a Cedis", ("carta anexo b convenio entrega en cedis", "carta anexo convenio entrega en cedis", "carta anexo convenio en cedis"), (), ()),
    ("Carta Intercedis", ("carta intercedis", "intercedis"), ("carta",), ()),
    ("Excepciones a Condiciones Logisticas", ("formato excepciones a condiciones logisticas", "excepciones a condiciones logisticas"), (), ()),
    ("Adendums Soporte", ("adendum", "adendums", "cartas de acuerdos de operaciones logisticas", "acuerdos de operaciones logisticas", "incrementando su costo", "incremento de costo"), (), ()),
    ("Carta Soporte Descuentos", (), ("carta soporte", "descuento"), ()),
    ("Carta Soporte Costos", ("costo", "costos"), ("carta soporte",), ("descuento", "descuentos")),
    ("Solicitud cambio Descuento", (), ("solicitud de cambio", "descuento"), ()),
    ("Solicitud Cambio Costo", ("costo", "costos"), ("solicitud de cambio",), ("descuento", "descuentos")),
    ("Convenio Modificatorio Cedis", (), ("convenio modificatorio", "cedis"), ()),
    ("Convenio Modificatorio Local", ("carta anexo b convenio entrega en tienda", "convenio modificatorio"), ("tienda",), ()),
    ("Comida Rapida", ("contrato comida rapida", "comida rapida"), (), ()),
    ("Convenio de Manufactura y Suministros", ("convenio de manufactura y suministros", "convenio de manufactura y suministro de productos"), (), ()),
    ("Convenio Entrega Cedis", ("convenio entrega en cedis", "convenio entrega cedis"), (), ("carta anexo",)),
    ("Convenio Entrega Local", ("convenio proveedores locales", "proveedores locales"), (), ()),
    ("Convenio Factoraje", ("convenio relativo a la mecanica operativa del sistema de factoraje", "factoraje"), ("convenio",), ()),
    ("Convenio Genericos", ("convenio oxxo genericos", "oxxo genericos"), (), ()),
    ("Convenio Logistico", ("convenio logistico",), (), ()),
    ("Convenio Condiciones Comerciales", ("convenio condiciones comerciales",), ("condiciones comerciales",), ()),
    ("Importaciones Marca Propia", ("contrato importaciones marcas propias", "importaciones marcas propias"), (), ()),
    ("Importations Contract", ("importations contract of store brand", "importations contract"), (), ()),
    ("Logistico MP", ("contrato logistico marca propia personas morales", "logistico marca propia personas morales"), (), ()),
    ("Marca Propia CEDIS", ("contrato entrega en cedis marca propia personas fisicas", "entrega en cedis marca propia personas fisicas"), (), ()),
    ("Marca Propia Tiendas", ("contrato marca propia personas morales entrega en tienda", "marca propia personas morales entrega en tienda"), (), ()),
    ("Portal de Proveedores", ("convenio para acceso a portal de proveedores", "convenio portal de proveedores", "portal de proveedores"), (), ()),
    ("Product Supply Agreement", ("product supply agreement",), (), ()),
    ("Proveedores Nacionales y Regionales Cedis", ("proveedores nacionales y regionales a cedis",), (), ()),
    ("Suministro de Materias Primas", ("convenio de suministro de materias primas personas morales", "carta anexo a convenio de suministro de materias primas a personas morales"), (), ()),
    ("Suministro de Productos de Linea en CEDIS", ("contrato de suministro de productos de linea en cedis", "suministro de productos de linea en cedis"), (), ()),
)
FIRST_PAGE, FIRST_LINES = 7000, 1200
