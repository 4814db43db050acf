"""Word lists, lookup tables and document wording used by the extractors.

These are fixed values: results are only right if they are exactly these.
"""

# --- fixed values -----------------------------------------------------------
HTTP_DECORATORS = ["Get", "Post", "Put", "Delete", "Patch"]
RELATION_DECORATORS = ["OneToOne", "OneToMany", "ManyToOne", "ManyToMany"]
RELATION_SYMBOLS = {
    "OneToOne": "||--||",
    "ManyToOne": "o|--||",
    "OneToMany": "||--|o",
    "ManyToMany": "o|--|o",
}
ORM_MARKERS = ["typeorm", "sequelize", "mongoose"]  # tested in this order
ENTITY_MARKER = "@Entity"
TREE_EXCLUDES = ["node_modules", "dist", ".git", "output"]
CLASS_DOCS = "Parsed with Go regex + esbuild"
INTERFACE_DOCS = "Parsed from TypeScript interface"
METHOD_DOCS = ("Input: (", ")\nOutput: ")  # around the parameters, before the return type
SCALAR_TYPES = ["string", "number", "boolean", "undefined", "null", "void", "File"]
OPAQUE_TYPES = ["any", "unknown", "{}"]
BUILT_IN_GENERICS = [
    "Array", "ReadonlyArray", "Promise", "Observable", "Set", "Map", "WeakMap", "WeakSet", "Record", "Partial", "Required",
    "Readonly", "Pick", "Omit", "Exclude", "Extract", "NonNullable", "Awaited", "Iterable",
]
# Words that may stand in front of the names of classes and methods that are listed.
CLASS_WORDS = ["export", "abstract"]
ACCESS_WORDS = ["public", "private", "protected"]
METHOD_WORDS = [*ACCESS_WORDS, "async"]
# Interface references.
INTERFACE_REF = r"^(I[A-Z]\w+)"
INTERFACE_TUPLE_REF = r"\[(I[A-Z]\w+)\]"
# --- end of fixed values ----------------------------------------------------
