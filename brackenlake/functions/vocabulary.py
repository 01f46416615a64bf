"""Fixed values that results depend on: word lists, tables and weights."""

# Fixed values.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can need "
    "dare ought used to of in for on with at by from as into through during before after above below between out off "
    "over under again further then once here there when where why how all both each few more most other some such no "
    "nor not only own same so than too very just because if while and but or yet either neither every any that this it "
    "its what which who whom these those implemented"
).split()
#: Stop words of the plain-text scan: the first list without some words, and verbs of requests.
SCAN_STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can need dare ought used "
    "to of in for on with at by from as into through during before after above below between out off over under again further then "
    "once here there when where why how all both each few more most other some such no nor not only own same so than too very just "
    "and but or if while that this it its what which who whom implemented find show get set make create update delete remove add list"
).split()
#: Terms that a query's words add to its search.
QUERY_ALIASES = {"dtslint": ["dtslint", "pnpm", "test"], "dts": ["dts", "index.d.ts"], "type": ["type", "index.d.ts"], "types": ["types", "index.d.ts"]}
TEST_TERMS = ["test", "tests", "testing", "spec", "specs", "dtslint", "pytest", "unittest"]
SYNONYMS = {
    "add": ["add", "create", "new"], "create": ["create", "add", "new"], "new": ["new", "create", "add"], "make": ["make", "create", "add"],
    "package": ["package", "workspace"], "workspace": ["workspace", "package"], "install": ["install", "add", "setup"],
    "setup": ["setup", "install", "configure"], "set": ["set", "setup", "install"], "auth": ["auth", "authentication"],
    "authentication": ["authentication", "auth"], "config": ["config", "configuration", "settings"], "configuration": ["configuration", "config"],
    "settings": ["settings", "config"], "db": ["db", "database"], "database": ["database", "db"], "repo": ["repo", "repository"],
    "repository": ["repository", "repo"], "error": ["error", "exception"], "exception": ["exception", "error"], "test": ["test", "spec"],
    "spec": ["spec", "test"], "deploy": ["deploy", "release"], "release": ["release", "deploy"], "dtslint": ["dtslint", "pnpm", "test"],
    "dts": ["dts", "index.d.ts"], "type": ["type", "index.d.ts"], "types": ["types", "type", "index.d.ts"],
}
FILE_CLASS_BOOST = {"Documentation": 1.4, "Config": 1.2, "Source": 1.0, "Test": 0.7, "Generated": 0.5, "Stylesheet": 0.0, "Binary": 0.0, "Vendor": 0.0, "Dependency": 0.0}
TEST_PENALTY, TEST_BOOST = 0.6, 1.4
#: Intents in their order, with the weights of Documentation, Config, Source, Test; Generated is 0.5, all others 0.
INTENT_WEIGHTS = {
    "Procedural": (2.5, 1.4, 0.8, 0.25), "Informational": (1.4, 1.1, 1.0, 0.6), "Implementation": (1.0, 1.0, 1.5, 0.7),
    "Debugging": (1.0, 1.2, 1.5, 1.3), "Testing": (1.6, 1.3, 1.0, 1.5), "Configuration": (1.1, 1.8, 1.0, 0.5),
    "Architecture": (1.6, 1.5, 1.1, 0.6), "Navigation": (0.9, 0.9, 1.3, 0.7), "Structural": (0.8, 0.8, 1.5, 0.7),
}
#: Language: extensions, manifest file names.
LANGUAGES = {
    "rust": (["rs"], ["Cargo.toml"]), "typescript": (["ts", "mts", "cts"], []), "tsx": (["tsx"], []), "javascript": (["js", "mjs", "cjs"], ["package.json"]),
    "jsx": (["jsx"], []), "python": (["py", "pyi"], ["pyproject.toml", "setup.py", "requirements.txt"]), "csharp": (["cs"], []), "go": (["go"], ["go.mod"]),
    "java": (["java"], ["pom.xml", "build.gradle"]), "c": (["c", "h"], []), "cpp": (["cpp", "cc", "cxx", "hpp"], []), "ruby": (["rb"], ["Gemfile"]),
    "php": (["php"], ["composer.json"]), "swift": (["swift"], ["Package.swift"]), "kotlin": (["kt", "kts"], []), "scala": (["scala"], ["build.sbt"]),
    "haskell": (["hs"], []), "elixir": (["ex", "exs"], ["mix.exs"]), "erlang": (["erl"], []), "lua": (["lua"], []), "zig": (["zig"], ["build.zig"]),
    "r": (["r", "R"], []), "ocaml": (["ml"], []), "clojure": (["clj"], []), "fsharp": (["fs", "fsx"], []), "vb": (["vb"], []), "sql": (["sql"], []),
    "shell": (["sh", "bash", "zsh"], []), "protobuf": (["proto"], []), "graphql": (["graphql", "gql"], []), "terraform": (["tf", "hcl"], []),
    "vue": (["vue"], []), "svelte": (["svelte"], []), "markdown": (["md"], []), "yaml": (["yaml", "yml"], []), "toml": (["toml"], []),
    "json": (["json"], []), "xml": (["xml"], []), "html": (["html"], []), "css": (["css"], []), "scss": (["scss"], []), "text": (["txt"], []),
}
#: Names that a language goes by, besides its own.
LANGUAGE_ALIASES = {
    "rs": "rust", "ts": "typescript", "typescriptreact": "tsx", "js": "javascript", "javascriptreact": "jsx", "py": "python",
    "c#": "csharp", "cs": "csharp", "c++": "cpp", "rb": "ruby", "kt": "kotlin", "hs": "haskell", "ex": "elixir", "erl": "erlang",
    "ml": "ocaml", "clj": "clojure", "f#": "fsharp", "fs": "fsharp", "vb.net": "vb", "sh": "shell", "bash": "shell", "zsh": "shell",
    "proto": "protobuf", "gql": "graphql", "tf": "terraform", "hcl": "terraform", "md": "markdown", "yml": "yaml", "txt": "text",
}
#: Endings and names of files that are indexed as text though they are in no known language.
TEXT_EXTENSIONS = (
    "toml yaml yml json xml md txt sql sh bash zsh env gitignore dockerfile makefile cmake gradle sbt cshtml razor csproj sln vb vbproj "
    "fs fsx fsproj config props targets ini cfg conf proto graphql gql tf hcl pkl liquid twig vue svelte"
).split()
TEXT_NAMES = ["dockerfile", "makefile", "cmakelists.txt", "justfile", "procfile"]
#: Two directories of the service's own editor settings are in no list here, as this engine has none.
VENDOR_DIRS = ["vendor", "node_modules", "third_party", "extern", "external", ".git", ".svn", ".hg", "__pycache__", ".cache", ".vscode", ".idea", ".vs", ".devcontainer"]
GENERATED_DIRS = ["generated", "gen", "auto-generated", "__generated__"]
DEPENDENCY_DIRS = ["target", "bin", "obj", "dist", "build", ".gradle", ".next", ".nuxt"]
TEST_DIRS = ["test", "tests", "__tests__", "test_data", "testdata", "fixtures", "spec"]
BINARY_EXTENSIONS = ["exe", "dll", "so", "dylib", "o", "a", "lib", "bin", "dat", "png", "jpg", "jpeg", "gif", "bmp", "ico", "pdf", "zip", "tar", "gz", "woff", "woff2", "ttf"]
DOC_EXTENSIONS = ["md", "txt", "rst"]
CONFIG_EXTENSIONS = ["toml", "yaml", "yml", "json", "xml", "ini", "cfg", "env"]
#: Words before a bracket that are no calls.
CALL_KEYWORDS = (
    "if else for while loop match return break continue fn struct enum impl trait type pub mod use class interface extends implements "
    "new this super function const let var import from export def self async await move"
).split()
ENUMERATION_WORDS = ["find ", "show ", "list ", "all ", "where is ", "where are "]
NO_PATHS = ["todo", "no", "this", "true", "false"]
#: Boosts of path endings and parts, and of documentation by its place.
README_ENDINGS = ["readme.md", "contributing.md", "contributing", "claude.md", "agents.md"]
DIRECTORY_BOOST = {"ending": 1.3, "docs": 1.2, "types": 1.15, "workspace": 1.1}
AUTHORITY_BOOST = {"readme": 1.5, "readme.x": 1.1, "index": 1.3, "docs": 1.2, "github": 1.1, "root": 1.2}
#: Phrases of the intents, in the order of their rules; a tuple of two lists asks for one of each.
INTENT_PHRASES = {
    "testing": ["dtslint"], "tested": (["test"], ["how", "run", "coverage", "spec"]), "test package": (["testing"], ["package"]), "are tested": (["how are"], ["tested"]),
    "how": ["how do i", "how to", "steps to", "getting started", "set up", "setup", "add a new package", "create a new package", "create a package", "add package"],
    "how add": (["how"], ["add", "create", "install"]), "debug": ["why does", "why is", "fail", "error", "bug", "broken", "fix"],
    "configure": ["configure", "configuration", "pnpm-workspace"], "workspace": (["workspace"], ["organiz"]), "organised": ["organiz", "structure", "layout"],
    "structural": ["(", "find all function", "find all class", "find all method", "show all function", "find all struct", "find all enum", "show all class", "show all struct", "list all function", "list all class"],
    "place": ["where is", "where are", "located", "find ", "locate"], "architecture": ["architecture"], "build": ["implement", "build", "develop"], "running": [" running tests"],
}
SYMBOL_WEIGHT, CODE_BEHIND, GRAPH_BOOST, DAMPING, EXPANSION_WEIGHT, EXPANDED_BOOST, DOC_SLOTS = 1.5, 0.8, 1.2, 0.1, 0.5, 1.05, 2
HISTOGRAM_BOUNDS = {"tokens": [100, 500, 1000, 2000, 5000, 10000, 20000, 30000], "files": [1, 5, 10, 20, 50], "seconds": [0.001, 0.01, 0.1, 0.5, 1]}
FIELD_BOOSTS = {"symbol_name": 3.0, "title": 2.5, "path": 2.5, "symbols": 2.0, "filename": 2.0, "content": 1.0}
BM25_K1, BM25_B = 1.2, 0.75
SCORE_SCALE = 1000.0
DOMAIN_TERMS = ["user", "auth", "session", "permission", "role", "token", "api", "endpoint", "route", "middleware", "handler", "service", "repository", "model", "schema", "migration", "config", "cache", "queue", "event"]


def sql_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"
