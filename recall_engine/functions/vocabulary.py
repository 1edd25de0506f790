"""Fixed values that results depend on: kinds of files, words of queries, limits. Each list is in its natural order."""

from __future__ import annotations

# Extensions by what a person calls them.
KINDS: dict[str, tuple[str, ...]] = {
    "pdf": ("pdf",),
    "document": ("doc", "docx", "odt", "rtf", "pages"),
    "spreadsheet": ("xls", "xlsx", "xlsm", "ods", "csv", "tsv", "numbers"),
    "presentation": ("ppt", "pptx", "odp", "key"),
    "text": ("txt", "md", "markdown", "rst", "org", "tex", "log"),
    "code": (
        "py", "ipynb", "js", "mjs", "ts", "tsx", "jsx", "java", "c", "h", "cpp", "hpp", "cs", "go", "rs", "rb", "php", "swift",
        "kt", "scala", "r", "m", "sql", "sh", "zsh", "bash", "lua", "pl", "f90", "jl", "html", "htm", "css", "scss", "vue",
        "svelte", "json", "yaml", "yml", "toml", "xml", "ini", "cfg", "conf", "mat",
    ),
    "email": ("eml", "emlx", "msg"),
    "image": (
        "png", "jpg", "jpeg", "gif", "heic", "heif", "webp", "tiff", "tif", "bmp", "svg", "raw", "cr2", "nef", "psd", "ai",
    ),
    "video": ("mp4", "mov", "avi", "mkv", "webm", "m4v"),
    "audio": ("mp3", "wav", "m4a", "aac", "flac", "ogg", "aiff", "aif", "flp", "mid", "midi"),
    "archive": ("zip", "rar", "7z", "tar", "gz", "tgz", "bz2", "xz", "dmg", "iso", "pkg"),
    "ebook": ("epub", "mobi", "azw3"),
}
EXT_KIND = {e: k for k, exts in KINDS.items() for e in exts}
# Kinds whose files are read as text, but for one extension, and the tables among them.
TEXT_EXTS = {*KINDS["text"], *KINDS["code"], "csv", "tsv"} - {"mat"}
# Other extensions whose text is extracted.
EXTRACTABLE = TEXT_EXTS | {"pdf", "docx", "pptx", "xlsx", "xlsm", "ods", "odt", "odp", "eml", "emlx", "rtf", "epub"}
# Extensions whose size is about that of their text.
TEXT_LIKE = {"txt", "md", "markdown", "csv", "tsv", "json", "html", "htm", "xml", "tex", "rst", "py", "js", "ts", "ipynb"}
# Extensions of folders that are one document.
PACKAGES = {"pages", "numbers", "key", "rtfd", "app", "band", "logicx", "scriv", "sketch", "graffle", "playground"}
# Ends of names of folders left out.
SKIPPED_SUFFIXES = (
    ".framework", ".bundle", ".photoslibrary", ".musiclibrary", ".xcodeproj", ".xcworkspace", ".lproj", ".egg-info",
    ".dist-info", ".plugin", ".kext",
)
# Names of folders left out.
SKIPPED_FOLDERS = (
    ".git", ".hg", ".svn", "node_modules", ".venv", "venv", "env", "__pycache__", "site-packages", "dist-packages", ".tox",
    ".mypy_cache", ".pytest_cache", ".ruff_cache", ".cache", "Caches", "cache", ".Trash", ".next", ".nuxt", "build",
    "target", ".gradle", ".idea", ".vscode", "DerivedData", "Pods", ".npm", ".yarn", "bower_components",
    ".ipynb_checkpoints", "Library", ".DocumentRevisions-V100", ".Spotlight-V100", ".fseventsd", ".TemporaryItems",
    "$RECYCLE.BIN", "Photos Library.photoslibrary", "Music Library.musiclibrary",
)
# Names of files left out, as globs.
SKIPPED_FILES = (
    ".DS_Store", "*.pyc", "*.pyo", "*.o", "*.so", "*.dylib", "*.class", "*.tmp", "~$*", "*.swp", ".localized", "Icon\r",
    "*.crdownload", "*.part", "*.lock", "*.aux", "*.fls", "*.fdb_latexmk", "*.synctex.gz", "*.bbl", "*.blg", "*.toc",
    "*.lof", "*.lot", "*.nav", "*.snm", "*.vrb", "kaggle.json", "*.pem", "*.p12", "*.pfx", "*.kdbx", "id_rsa*",
    "id_ed25519*", "credentials*.json", "*secret*.json", "*.keychain", "*.keychain-db", "*.ovpn",
)
# Words without meaning in a search for files.
STOPWORDS = (
    "le", "la", "les", "l", "un", "une", "des", "de", "du", "d", "au", "aux", "et", "ou", "a", "en", "dans", "sur", "pour",
    "par", "avec", "sans", "mon", "ma", "mes", "ton", "ta", "tes", "son", "sa", "ses", "ce", "cet", "cette", "ces", "qui",
    "que", "quoi", "j", "je", "tu", "il", "elle", "on", "nous", "vous", "y", "ai", "est", "fichier", "fichiers", "doc",
    "document", "the", "of", "and", "or", "in", "for", "to", "my", "file", "files", "with", "an", "trouve", "trouver",
    "cherche", "chercher", "retrouve", "retrouver", "where", "find",
)
# Folders that hold copies or old versions.
NOISY_FOLDERS = (
    "archive", "archives", "old", "backup", "backups", "sauvegarde", "tmp", "temp", "corbeille", "trash", "copie", "copies",
    "anciens", "ancien",
)
# Roots that people know under two names.
ROOT_ALIASES = {"Downloads": "Downloads Téléchargements", "Desktop": "Desktop Bureau", "Documents": "Documents"}
# Parts of paths that keep a file out of samples.
SENSITIVE = (
    "paie", "salaire", "bulletin", "impot", "impôt", "fiscal", "banque", "bancaire", "releve", "relevé", "rib", "iban",
    "passeport", "passport", "identite", "identité", "cni", "permis", "carte vitale", "secu", "sécu", "medical", "médical",
    "ordonnance", "sante", "santé", "mutuelle", "importants", "billets", "billet", "password", "mot de passe",
    "contrat de travail", "avis d'imposition", "quittance", "bail", "caf", "pole emploi", "france travail", "urssaf",
    "naissance", "acte",
)
# Months and their short forms in French, then months in English, without accents.
MONTHS = {
    "janvier": 1, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11,
    "decembre": 12, "janv": 1, "fevr": 2, "fev": 2, "avr": 4, "juil": 7, "sept": 9, "oct": 10, "nov": 11, "dec": 12, "january": 1, "february": 2,
    "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}
# Labels of months.
MONTH_LABELS = [
    "Janvier", "Février", "Mars", "Avril", "Mai", "Juin", "Juillet", "Août", "Septembre", "Octobre", "Novembre", "Décembre",
]
# Words of numbers.
NUMBERS = {
    "un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "six": 6, "sept": 7, "huit": 8, "neuf": 9, "dix": 10, "quinze": 15, "a": 1, "an": 1,
    "one": 1, "two": 2, "three": 3, "few": 3, "quelques": 3,
}
# Words that name a type of file: a kind, or extensions.
TYPE_WORDS: dict[str, str | tuple[str, ...]] = {
    "pdf": ("pdf",), "pdfs": ("pdf",), "excel": "spreadsheet", "tableur": "spreadsheet", "spreadsheet": "spreadsheet", "feuille de calcul": "spreadsheet",
    "xlsx": ("xlsx", "xlsm", "xls"), "xls": ("xls", "xlsx"), "csv": ("csv", "tsv"), "word": "document", "docx": ("docx", "doc"), "doc word": "document",
    "presentation": "presentation", "presentations": "presentation", "powerpoint": "presentation", "ppt": "presentation", "pptx": "presentation",
    "keynote": "presentation", "slides": "presentation", "diapo": "presentation", "diapos": "presentation", "diaporama": "presentation", "image": "image",
    "images": "image", "photo": "image", "photos": "image", "capture d'ecran": "image", "capture ecran": "image", "screenshot": "image", "png": ("png",),
    "jpg": ("jpg", "jpeg"), "jpeg": ("jpg", "jpeg"), "heic": ("heic",), "video": "video", "videos": "video", "mp4": ("mp4",), "mov": ("mov",),
    "audio": "audio", "musique": "audio", "mp3": ("mp3",), "enregistrement audio": "audio", "vocal": "audio", "mail": "email", "email": "email",
    "e-mail": "email", "courriel": "email", "zip": "archive", "archive zip": "archive", "script": ("py", "sh", "js", "ts", "r", "m", "jl"),
    "python": ("py", "ipynb"), "notebook": ("ipynb",), "markdown": ("md", "markdown"), "txt": ("txt",), "epub": ("epub",), "ebook": "ebook",
}
# Type words that are ordinary words too; they stay in the searched text.
KEPT_WORDS = {
    "presentation", "presentations", "slides", "diapo", "diapos", "diaporama", "image", "images", "photo", "photos",
    "video", "videos", "audio", "musique", "vocal", "mail", "email", "e-mail", "courriel", "script", "notebook",
    "screenshot", "capture d'ecran", "capture ecran", "enregistrement audio", "ebook",
}
# Labels of kinds.
TYPE_LABELS = {
    "spreadsheet": "Tableur", "document": "Document Word", "presentation": "Présentation", "image": "Image", "video": "Vidéo", "audio": "Audio",
    "email": "E-mail", "archive": "Archive",
}
# Articles and prepositions cut at both ends of a query.
FILLERS = [
    "le", "la", "les", "un", "une", "des", "du", "de", "d'", "l'", "mon", "ma", "mes", "en", "au", "the", "my", "a", "an",
    "in", "from", "of", "dans", "sur", "pour",
]
