"""Word lists, tables and patterns that results depend on."""

# Brands.
BRANDS = [
    "gigabyte", "asus", "msi", "zotac", "evga", "galax", "pny", "palit", "sapphire", "powercolor",
    "xfx", "intel", "amd", "nvidia", "corsair", "kingston", "crucial", "adata", "xpg", "seagate",
    "western digital", "wd", "samsung", "sandisk", "logitech", "razer", "hyperx", "redragon",
    "husky", "pichau", "rise mode", "thermaltake", "cooler master", "noctua", "deepcool", "nzxt",
    "aoc", "lg", "benq", "acer", "dell", "alienware", "lenovo", "hp", "apple", "positivo", "vaio",
    "multilaser", "tp-link", "intelbras", "mercusys", "ubiquiti", "asrock", "biostar", "gainward",
    "oster", "philips", "walita", "philips walita", "electrolux", "brastemp", "consul", "mondial",
    "britania", "arno", "cadence", "delonghi", "de'longhi", "nespresso", "dolce gusto", "tramontina",
    "panasonic", "midea", "springer", "gree", "fischer", "atlas", "itatiaia", "esmaltec", "nescafe",
    "motorola", "xiaomi", "realme", "sony", "jbl",
    "anker", "baseus", "edifier", "tcl", "philco", "aiwa", "roku", "amazon",
    "nike", "adidas", "puma", "olympikus", "mizuno", "asics", "fila", "new balance", "under armour",
    "oakley", "havaianas", "vans", "converse", "reebok", "topper", "penalty",
]
# Categories.
CATEGORIES = [
    "cafeteira", "cafeteira expresso", "notebook", "monitor", "placa de video", "placa mae",
    "processador", "memoria ram", "ssd", "hd", "fonte", "gabinete", "water cooler", "cooler",
    "teclado", "mouse", "mousepad", "headset", "fone", "fone de ouvido", "caixa de som", "webcam",
    "impressora", "roteador", "smartphone", "celular", "tablet", "smartwatch", "relogio",
    "televisao", "tv", "smart tv", "geladeira", "fogao", "cooktop", "micro-ondas", "microondas",
    "lava-loucas", "lava louças", "maquina de lavar", "lavadora", "secadora", "ar condicionado",
    "ventilador", "aspirador", "robo aspirador", "liquidificador", "batedeira", "air fryer",
    "fritadeira", "sanduicheira", "panela", "panela de pressao", "jogo de panelas", "chaleira",
    "torradeira", "forno", "purificador", "tenis", "camiseta", "bermuda", "jaqueta", "mochila",
    "bicicleta", "esteira", "halter", "cadeira gamer", "cadeira de escritorio", "mesa",
    "furadeira", "parafusadeira", "serra", "lixadeira", "compressor", "multimetro", "console",
    "controle", "jogo", "placa de captura", "nobreak", "estabilizador", "filtro de linha",
]
# Product lines and the brand that each implies.
LINES = {
    "iphone": "apple", "ipad": "apple", "macbook": "apple", "imac": "apple", "airpods": "apple",
    "watch": None, "galaxy": "samsung", "redmi": "xiaomi", "poco": "xiaomi", "zenfone": "asus",
    "vivobook": "asus", "zenbook": "asus", "tuf": "asus", "rog": "asus", "thinkpad": "lenovo",
    "ideapad": "lenovo", "legion": "lenovo", "loq": "lenovo", "inspiron": "dell", "vostro": "dell",
    "latitude": "dell", "xps": "dell", "nitro": "acer", "predator": "acer", "aspire": "acer",
    "pavilion": "hp", "omen": "hp", "victus": "hp", "moto": "motorola", "nespresso": "nespresso",
    "playstation": "sony", "ps5": "sony", "xbox": "microsoft", "switch": "nintendo",
}
# Words left out of tokens.
STOP_WORDS = ["de", "da", "do", "com", "para", "e", "a", "o", "em", "no", "na", "por", "ou", "the", "novo", "nova"]
# Words that describe a unit, not a product.
WEAK_WORDS = [
    "polegadas", "polegada", "pol", "gb", "tb", "mb", "ram", "ssd", "hd", "memoria", "armazenamento",
    "tela", "display", "versao", "geracao", "ger", "ano", "modelo", "cor", "unidade", "unidades",
    "produto", "oficial", "original", "lacrado", "nacional", "garantia", "nf", "nota", "fiscal",
]
# Marks of imported, used and accessory listings (tested as substrings).
IMPORT_WORDS = [
    "importado", "importada", "versao internacional", "versão internacional", "global version",
    "international version", "envio do exterior", "produto importado", "imported", "eu plug",
    "us plug", "plugue americano", "plug americano",
]
USED_WORDS = [
    "usado", "seminovo", "semi-novo", "recondicionado", "vitrine", "outlet", "reembalado", "open box",
    "com avaria", "defeito", "para retirada de peças",
]
ACCESSORY_WORDS = [
    "suporte", "capa", "case ", "capinha", "pelicula", "película", "cabo", "adaptador", "carregador",
    "fonte para", "bateria para", "protetor", "skin", "adesivo", "bolsa", "estojo", "filtro para",
    "refil", "kit de limpeza", "porta ", "organizador", "mousepad", "base para", "mesa para", "bag",
    "sleeve", "controle remoto para", "gabinete", "enclosure", "bandeja", "bico ", "nozzle", "hotend",
    "placa de construcao", "filamento", "spool", "ventilacao", "ventilação", "pote", "potes", "tampa",
    "tampas", "reposicao", "reposição", "acessorio", "acessório", "pacote com", "unidades",
    "peças de", "pecas de", "compativel com", "compatível com", "manual do", "guia de", "receitas",
    "livro", "cookbook", "cook book", "recipe", "recipes", "receituario", "receituário", "ebook",
    "e-book", "kindle", "paperback", "hardcover", "edicao revisada", "beginners", "guide to",
    "guia completo", "livre de recettes", "recettes",
]
# Suffixes that make another product.
GLUED_SUFFIXES = ["ti", "super", "xt", "xtx", "s"]
LOOSE_VARIANTS = ["ti", "super", "xt", "xtx", "pro", "max", "plus", "ultra", "mini", "air"]
# Words after a model that name no line.
LINE_NOISE = [
    "oc", "placa", "video", "geforce", "nvidia", "amd", "radeon", "intel", "gamer", "notebook", "com",
    "para", "de", "da", "do", "ram", "ssd", "hd", "ddr", "gddr", "gddr6", "gddr7", "ddr4", "ddr5",
    "bits", "core", "dual", "edition", "nova", "novo", "super", "pro", "max", "ultra", "lite", "plus",
    "ti", "ryzen", "celeron", "athlon", "pentium", "snapdragon", "dimensity", "silver", "tela",
    "memoria", "dlss", "ray", "tracing", "sff", "wuxga", "oled", "ips", "led", "lcd", "fhd", "uhd",
    "qhd", "wifi", "bluetooth", "rgb", "ghz", "mhz", "windows", "linux", "home", "pro64",
]
# Colours in order of precedence, pattern and name.
COLOURS = [
    (r"cinza\s*espacial", "cinza espacial"),
    (r"preto[\s-]+espacial", "preto espacial"),
    (r"meia[\s-]?noite", "meia-noite"),
    (r"estelar", "estelar"),
    (r"pratead[oa]", "prata"),
    (r"dourad[oa]", "dourado"),
    (r"grafite", "grafite"),
    (r"prata", "prata"),
    (r"rosa", "rosa"),
    (r"azul", "azul"),
    (r"verde", "verde"),
    (r"vermelh[oa]", "vermelho"),
    (r"amarel[oa]", "amarelo"),
    (r"roxo", "roxo"),
    (r"marrom", "marrom"),
    (r"bege", "bege"),
    (r"branco", "branco"),
    (r"preto", "preto"),
    (r"cinza", "cinza"),
]
# Quantities and dry attributes on normalised text.
QUANTITY = r"\b(\d+(?:[.,]\d+)?)\s*(gb|tb|mb|ghz|mhz|bits|bit|w|v|hz|ml|l|kg|g|mm|cm|pol|polegadas|\"|k|p)(?![a-z0-9])"
DRY_ATTRIBUTE = r"\b(ddr\d|4k|8k|full hd|fhd|uhd|qhd|wifi\s?6e?|usb\s?c|type\s?c|bivolt|110v|127v|220v)\b"
PROCESSOR = r"\b(ryzen\s*[3579]|core\s*i[3579]|core\s*ultra\s*[579]|celeron|athlon|pentium|snapdragon|dimensity|apple\s*m[1234])\b"
# Company-like and empty brand fields.
COMPANY = r"(?i)(ltda|s\.?a\.?$|eireli|mei\b|comercio|comércio|industria|indústria|distribuidora|importacao|importação|servicos|serviços|intermedia|negocios|negócios|me\b|epp\b)"
NO_BRAND = r"(?i)^(n[ãa]o informad[oa]|sem marca|generic[oa]?|outros?|diversos?|marca)$"
#: Short names of the months; words that a family's title neither begins nor ends with.
SHORT_MONTHS = ["jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez"]
TITLE_EDGE_WORDS = ["de", "da", "do", "com", "para", "e", "a", "o", "em", "the", "chip", "processador", "polegadas", "pol", "modelo", "novo", "nova"]
