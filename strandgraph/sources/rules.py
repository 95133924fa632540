"""Declarative extraction rules: patterns per language, applied line by line with Spark regexes.

A definition rule is (node kind, pattern); group 1 is the name, group 2 if present the list of
supertypes. Patterns see lines whose comments are blanked out.
"""

_ID = r"([A-Za-z_$][\w$]*)"
_JS = [
    ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_ID}([^{{]*)"),
    ("interface", rf"^\s*(?:export\s+)?(?:declare\s+)?interface\s+{_ID}([^{{]*)"),
    ("type_alias", rf"^\s*(?:export\s+)?(?:declare\s+)?type\s+{_ID}\s*(?:<[^=]*>)?\s*="),
    ("enum", rf"^\s*(?:export\s+)?(?:const\s+)?(?:declare\s+)?enum\s+{_ID}"),
    ("namespace", rf"^\s*(?:export\s+)?(?:declare\s+)?namespace\s+{_ID}"),
    ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_ID}"),
    ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+{_ID}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>"),
    ("constant", rf"^(?:export\s+)?const\s+{_ID}\s*(?::[^=]+)?=\s*(?!\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>)"),
    ("variable", rf"^(?:export\s+)?(?:let|var)\s+{_ID}\b(?!.*=>)"),
    ("method", rf"^\s+(?:(?:public|private|protected|abstract|readonly)\s+)*{_ID}\??\s*(?:<[^>]*>)?\s*\([^)]*\)\s*:\s*[^{{;=]+;\s*$"),
    ("method", rf"^\s+(?:(?:public|private|protected|static|async|override|abstract|readonly|get|set)\s+)*\*?#?{_ID}\s*(?:<[^>]*>)?\s*\([^)]*\)\s*(?::[^{{;=]+)?\s*\{{"),
]
_C = [
    ("struct", rf"^\s*(?:typedef\s+)?struct\s+{_ID}\s*(?:\{{|$)"),
    ("enum", rf"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?{_ID}\s*(?::\s*\w+\s*)?(?:\{{|$)"),
    ("function", rf"^(?!\s*(?:return|else|typedef|new|throw|case)\b)[A-Za-z_][\w\s*&:<>,~]*?[\s*&]((?:[A-Za-z_]\w*::)*~?[A-Za-z_]\w*)\s*\([^;]*\)\s*(?:const\s*)?(?:override\s*)?(?:noexcept\s*)?(?:\{{|$)"),
    ("constant", rf"^\s*#\s*define\s+{_ID}"),
]
_JVM_MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|data|override|partial|virtual|async|readonly|inline|suspend|case|implicit|lateinit|default|synchronized|native|expect|actual|enum|annotation|inner|companion|extern|unsafe|new|lazy|tailrec|operator|infix)\s+)*"

# Definition patterns.
DEFINITIONS: dict[str, list[tuple[str, str]]] = {
    "typescript": _JS, "tsx": _JS, "javascript": _JS, "jsx": _JS, "svelte": _JS, "vue": _JS, "astro": _JS,
    "python": [
        ("class", rf"^\s*class\s+{_ID}\s*(?:\(([^)]*)\))?\s*:"),
        ("function", rf"^\s*(?:async\s+)?def\s+{_ID}"),
        ("constant", r"^([A-Z][A-Z0-9_]*)\s*(?::[^=]+)?=(?!=)"),
        ("variable", r"^([a-z_]\w*)\s*(?::[^=]+)?=(?!=)"),
    ],
    "go": [
        ("struct", rf"^\s*(?:type\s+)?{_ID}\s+struct\b"),
        ("interface", rf"^\s*(?:type\s+)?{_ID}\s+interface\b"),
        ("type_alias", rf"^\s*type\s+{_ID}\s+(?!struct\b|interface\b)\S"),
        ("method", rf"^func\s+\(\s*\w*\s*\*?\w+(?:\[[^\]]*\])?\s*\)\s*{_ID}"),
        ("function", rf"^func\s+{_ID}"),
        ("method", r"^\s+([A-Z]\w*)\([^)]*\)\s+[\w*.(\[][\w*.()\[\], ]*$"),
        ("constant", rf"^const\s+{_ID}"), ("variable", rf"^var\s+{_ID}"),
    ],
    "rust": [
        ("struct", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+{_ID}"),
        ("enum", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+{_ID}"),
        ("trait", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+{_ID}\s*(:[^{{]*)?"),
        ("module", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+{_ID}\s*\{{"),
        ("type_alias", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+{_ID}"),
        ("constant", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+{_ID}\s*:"),
        ("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+{_ID}"),
    ],
    "java": [
        ("class", rf"^\s*{_JVM_MOD}(?:class|record)\s+{_ID}([^{{]*)"),
        ("interface", rf"^\s*{_JVM_MOD}@?interface\s+{_ID}([^{{]*)"),
        ("enum", rf"^\s*{_JVM_MOD}enum\s+{_ID}"),
        ("method", rf"^\s+(?!return\b|new\b|else\b|throw\b){_JVM_MOD}(?:<[^>]+>\s+)?(?:[\w.<>\[\],?]+\s+)?{_ID}\s*\([^;{{]*\)\s*(?:throws\s+[\w.,\s]+)?(?:\{{|;)"),
        ("field", rf"^\s+(?:(?:public|private|protected|static|final|volatile|transient)\s+)+[\w.<>\[\],?]+\s+{_ID}\s*(?:=|;)"),
    ],
    "kotlin": [
        ("class", rf"^\s*{_JVM_MOD}(?:class|object)\s+{_ID}([^{{]*)"),
        ("interface", rf"^\s*{_JVM_MOD}(?:fun\s+)?interface\s+{_ID}([^{{]*)"),
        ("type_alias", rf"^\s*typealias\s+{_ID}"),
        ("function", rf"^\s*{_JVM_MOD}fun\s+(?:<[^>]+>\s*)?(?:[\w.<>]+\.)?{_ID}"),
        ("property", rf"^\s+{_JVM_MOD}(?:val|var)\s+{_ID}"), ("variable", rf"^{_JVM_MOD}(?:val|var)\s+{_ID}"),
    ],
    "scala": [
        ("class", rf"^\s*{_JVM_MOD}(?:class|object)\s+{_ID}([^{{=]*)"), ("trait", rf"^\s*{_JVM_MOD}trait\s+{_ID}([^{{]*)"),
        ("function", rf"^\s*{_JVM_MOD}def\s+{_ID}"), ("property", rf"^\s+{_JVM_MOD}(?:val|var)\s+{_ID}"),
        ("type_alias", rf"^\s*{_JVM_MOD}type\s+{_ID}\s*="),
    ],
    "c": _C,
    "cpp": [
        ("class", rf"^\s*(?:template\s*<[^>]*>\s*)?class\s+(?:\w+\s+)?{_ID}\s*(?:final\s*)?(:[^{{;]*)?\s*(?:\{{|$)"),
        ("namespace", rf"^\s*namespace\s+{_ID}"),
        ("type_alias", rf"^\s*using\s+{_ID}\s*="), *_C,
        ("method", rf"^\s+(?!return\b|else\b|new\b|throw\b|delete\b)(?:virtual\s+|static\s+|inline\s+|explicit\s+)*(?:[\w:<>,*&]+[\s*&]+)?{_ID}\s*\([^;{{]*\)\s*(?:const\s*)?(?:override\s*)?(?:=\s*0\s*)?(?:;|\{{)"),
    ],
    "csharp": [
        ("namespace", r"^\s*namespace\s+([\w.]+)"),
        ("class", rf"^\s*{_JVM_MOD}(?:class|record)\s+{_ID}([^{{]*)"),
        ("interface", rf"^\s*{_JVM_MOD}interface\s+{_ID}([^{{]*)"), ("struct", rf"^\s*{_JVM_MOD}struct\s+{_ID}([^{{]*)"),
        ("enum", rf"^\s*{_JVM_MOD}enum\s+{_ID}"),
        ("method", rf"^\s+(?!return\b|new\b|else\b|throw\b|await\b){_JVM_MOD}[\w.<>\[\],?]+\s+{_ID}\s*(?:<[^>]*>)?\s*\([^;{{]*\)\s*(?:\{{|=>|;|$)"),
        ("property", rf"^\s+{_JVM_MOD}[\w.<>\[\],?]+\s+{_ID}\s*\{{\s*(?:get|set)"),
    ],
    "php": [
        ("class", rf"^\s*(?:abstract\s+|final\s+)*class\s+{_ID}([^{{]*)"), ("interface", rf"^\s*interface\s+{_ID}([^{{]*)"),
        ("trait", rf"^\s*trait\s+{_ID}"), ("namespace", r"^\s*namespace\s+([\w\\]+)"),
        ("function", rf"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?{_ID}"),
        ("constant", rf"^\s*(?:(?:public|private|protected)\s+)?const\s+{_ID}\s*="),
    ],
    "ruby": [
        ("class", r"^\s*class\s+([A-Z][\w:]*)(\s*<\s*[\w:]+)?"), ("module", r"^\s*module\s+([A-Z][\w:]*)"),
        ("method", r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)"), ("constant", r"^\s*([A-Z][A-Z0-9_]*)\s*=(?!=)"),
    ],
    "swift": [
        ("class", rf"^\s*(?:(?:public|open|internal|private|fileprivate|final)\s+)*(?:class|actor)\s+(?!func\b|var\b){_ID}([^{{]*)"),
        ("struct", rf"^\s*(?:(?:public|internal|private|fileprivate)\s+)*struct\s+{_ID}([^{{]*)"),
        ("protocol", rf"^\s*(?:(?:public|internal|private|fileprivate)\s+)*protocol\s+{_ID}([^{{]*)"),
        ("enum", rf"^\s*(?:(?:public|internal|private|fileprivate|indirect)\s+)*enum\s+{_ID}([^{{]*)"),
        ("function", rf"^\s*(?:(?:public|open|internal|private|fileprivate|static|class|override|mutating|final|@\w+)\s+)*func\s+{_ID}"),
        ("property", rf"^\s+(?:(?:public|open|internal|private|fileprivate|static|lazy|weak|override|final)\s+)*(?:let|var)\s+{_ID}"),
    ],
    "dart": [
        ("class", rf"^\s*(?:abstract\s+|sealed\s+|base\s+|final\s+)*class\s+{_ID}([^{{]*)"), ("enum", rf"^\s*enum\s+{_ID}"),
        ("class", rf"^\s*mixin\s+{_ID}"),
        ("function", rf"^(?!\s*(?:return|else|await|new|throw)\b)\s*(?:static\s+)?(?:[\w<>?,\[\]]+\s+)+{_ID}\s*\([^;]*\)\s*(?:async\*?\s*)?(?:\{{|=>)"),
    ],
    "lua": [("function", r"^\s*(?:local\s+)?function\s+((?:\w+[.:])*\w+)"), ("function", r"^\s*(?:local\s+)?(\w+)\s*=\s*function\b"),
            ("variable", r"^local\s+(\w+)\s*=(?!\s*function)")],
    "objc": [
        ("interface", rf"^\s*@interface\s+{_ID}(\s*:\s*\w+)?"), ("class", rf"^\s*@implementation\s+{_ID}"),
        ("protocol", rf"^\s*@protocol\s+{_ID}\b(?!\s*;)"), ("method", r"^\s*[-+]\s*\([^)]*\)\s*(\w+)"), *_C,
    ],
    "pascal": [
        ("class", r"(?i)^\s*(T\w+)\s*=\s*class\b\s*(\([^)]*\))?"), ("interface", r"(?i)^\s*(I\w+)\s*=\s*interface\b"),
        ("struct", r"(?i)^\s*(\w+)\s*=\s*(?:packed\s+)?record\b"), ("module", r"(?i)^\s*unit\s+([\w.]+)"),
        ("function", r"(?i)^\s*(?:class\s+)?(?:function|procedure|constructor|destructor)\s+((?:\w+\.)*\w+)"),
    ],
    "liquid": [("component", r"\{%-?\s*(?:block|section)\s+['\"]([\w-]+)['\"]")],
    "xml": [("method", r"<(?:select|insert|update|delete|sql)\s[^>]*\bid\s*=\s*\"([^\"]+)\"")],
    "properties": [("constant", r"^\s*([\w.\-\[\]]+)\s*[=:]")],
    "yaml": [("constant", r"^\s*([\w.\-]+)\s*:")],
    "razor": [("function", r"^\s*(?:private|public|protected)\s+(?:async\s+)?[\w<>]+\s+(\w+)\s*\(")],
}
DEFINITIONS["luau"] = DEFINITIONS["lua"] + [("type_alias", r"^\s*(?:export\s+)?type\s+(\w+)\s*=")]

# Languages whose blocks follow indentation; in all others braces decide.
INDENTED = ["python", "ruby", "lua", "luau", "pascal", "yaml", "objc"]

# Import patterns; group 1 is the module or path.
_JS_IMPORT = [r"^\s*(?:import|export)\b[^'\"]*?from\s*['\"]([^'\"]+)['\"]", r"^\s*import\s*['\"]([^'\"]+)['\"]",
              r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)", r"\bimport\(\s*['\"]([^'\"]+)['\"]\s*\)"]
IMPORTS: dict[str, list[str]] = {
    **{lang: _JS_IMPORT for lang in ("typescript", "tsx", "javascript", "jsx", "svelte", "vue", "astro")},
    "python": [r"^\s*from\s+([\w.]+)\s+import\b", r"^\s*import\s+([\w.]+)"],
    "go": [r"^\s*import\s+(?:\w+\s+)?\"([^\"]+)\"", r"^\s+(?:\w+\s+|_\s+|\.\s+)?\"([\w./\-]+)\"\s*$"],
    "rust": [r"^\s*(?:pub\s+)?use\s+([\w:]+)"], "java": [r"^\s*import\s+(?:static\s+)?([\w.]+)"],
    "kotlin": [r"^\s*import\s+([\w.]+)"], "scala": [r"^\s*import\s+([\w.]+)"],
    "c": [r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]"], "csharp": [r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"],
    "php": [r"^\s*use\s+([\w\\]+)", r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]"],
    "ruby": [r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]"], "swift": [r"^\s*import\s+(?:class\s+|struct\s+)?(\w+)"],
    "dart": [r"^\s*(?:import|export|part)\s+['\"]([^'\"]+)['\"]"], "lua": [r"\brequire\s*\(?\s*['\"]([^'\"]+)['\"]"],
    "pascal": [r"(?i)^\s*uses\s+([\w.]+)"], "liquid": [r"\{%-?\s*(?:render|include|section)\s+['\"]([\w\-/]+)['\"]"],
    "razor": [r"^\s*@(?:using|inject|model|inherits)\s+([\w.<>]+)"], "twig": [r"\{%-?\s*(?:extends|include|embed)\s+['\"]([^'\"]+)['\"]"],
}
for _a, _b in (("cpp", "c"), ("objc", "c"), ("luau", "lua")):
    IMPORTS[_a] = IMPORTS[_b]
IMPORTS["objc"] = IMPORTS["objc"] + [r"^\s*#\s*import\s*[<\"]([^>\"]+)[>\"]", r"^\s*@import\s+(\w+)"]

# Words a call pattern must not take for a function name.
NOT_CALLS = (
    "if for while switch catch return function func fn def class new typeof sizeof elif else and or not in is "
    "await async yield throw case do try with lambda match when unless until foreach using lock fixed import "
    "export super this self constructor defined print echo assert del raise except from where select guard defer"
).split()
CALL = r"(?<![\w$.:])((?:[A-Za-z_$][\w$]*(?:\(\))?(?:\.|::|->))*[A-Za-z_$][\w$]*)\s*\("
NEW = r"\bnew\s+([A-Za-z_][\w.]*)"
DECORATOR = r"^\s*@([A-Za-z_][\w.]*)"
TYPE_USE = r"(?::|->|<|,|\bextends|\bas)\s*([A-Z]\w+)"

# Strings and comments by language, found in one pass so that neither hides in the other.
# Longer openings come first; a match that opens like a string is kept, all else is blanked.
_DOUBLE, _SINGLE, _TICK = (rf"{q}[^{q}\\{end}]*+(?:\\.[^{q}\\{end}]*+)*+{q}" for q, end in (('"', "\\n"), ("'", "\\n"), ("`", "")))
_BLOCK, _SLASH = r"/\*[\s\S]*?(?:\*/|\z)", r"//[^\n]*"
_DOC = r'"""[\s\S]*?(?:"""|\z)|\'\'\'[\s\S]*?(?:\'\'\'|\z)'
_HASH = r"(?<![^\s;])#[^\n]*"
TOKENS = {
    "python": [_DOC, _DOUBLE, _SINGLE, _HASH], "yaml": [_DOUBLE, _SINGLE, _HASH], "properties": [r"(?m)^\s*[#!][^\n]*"],
    "ruby": [r"(?m)^=begin\b[\s\S]*?(?:^=end[^\n]*|\z)", _DOUBLE, _SINGLE, _HASH],
    "php": [_BLOCK, _DOUBLE, _SINGLE, _SLASH, r"#(?!\[)[^\n]*"], "lua": [_DOUBLE, _SINGLE, r"--\[\[[\s\S]*?(?:\]\]|\z)|--[^\n]*"],
    "luau": [_DOUBLE, _SINGLE, r"--\[\[[\s\S]*?(?:\]\]|\z)|--[^\n]*"], "pascal": [r"'[^'\n]*'", r"\{[\s\S]*?(?:\}|\z)", r"\(\*[\s\S]*?(?:\*\)|\z)", _SLASH],
    "rust": [_BLOCK, r'r#"[\s\S]*?(?:"#|\z)', r'r"[^"]*(?:"|\z)', _DOUBLE, r"'(?:\\.|[^'\\\n])'", _SLASH], "xml": [r"<!--[\s\S]*?(?:-->|\z)"],
}
# Languages with text blocks, which are strings here; only Python's count as documentation.
TEXT_BLOCKS = ["java", "kotlin", "scala", "swift", "csharp", "dart"]
DEFAULT_TOKENS = [_BLOCK, _DOUBLE, _SINGLE, _TICK, r"(?<!:)" + _SLASH]
TOKENS |= {lang: [_BLOCK, r'"""[\s\S]*?(?:"""|\z)', *DEFAULT_TOKENS[1:]] for lang in TEXT_BLOCKS}
