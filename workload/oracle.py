"""Expected results as DuckDB SQL, stated from the keys of the given tables.

No statement here sees source text or a pattern: each says which facts the files of a
key must hold, so an extractor that misreads a file cannot agree by accident.
"""

from __future__ import annotations

# The wording and the tables that results must hold, written out here on purpose: the library has its own.
CLASS_DOCS = "Parsed with Go regex + esbuild"
INTERFACE_DOCS = "Parsed from TypeScript interface"
SYMBOLS = [("OneToOne", "||--||"), ("ManyToOne", "o|--||"), ("OneToMany", "||--|o"), ("ManyToMany", "o|--|o")]
ERD_HINT = "(Paste into https://mermaid.live to visualize)"
TABLE_HEADER = "Column | Type | Decorators"

FILES = """
num AS (SELECT count(*) n FROM supplier),
cust AS (SELECT c_custkey k, c_nationkey n, 'p' || (c_custkey % num.n) project,
         'src/entities/c' || c_custkey || '.entity.ts' path FROM customer, num),
ord AS (SELECT o_orderkey k, o_custkey c, 'p' || (o_custkey % n) project,
        'src/orders/o' || o_orderkey || '.entity.ts' path FROM orders, num),
par AS (SELECT p_partkey k, p_size s, ((p_partkey // n) // 2) * n + p_partkey % n pk,
        'p' || (p_partkey % n) project, 'src/dto/d' || p_partkey || '.dto.ts' dto,
        'src/api/p' || p_partkey || '.controller.ts' path FROM part, num),
usr AS (SELECT u, u + 1 v, 'p' || (u % n) project, 'src/models/u' || u || '.ts' path
        FROM (SELECT DISTINCT user_id u FROM events), num),
sup AS (SELECT s_suppkey k, 'p' || s_suppkey project,
        'src/shapes/s' || s_suppkey || '.controller.ts' path,
        'src/shapes/far/f' || s_suppkey || '.dto.ts' far FROM supplier),
bro AS (SELECT s_suppkey k, 'p' || s_suppkey project, 'src/broken/b' || s_suppkey || '.ts' path
        FROM supplier WHERE s_suppkey % 3 = 0),
doc AS (SELECT doc_id k, 'p' || (doc_id % n) project, 'src/docs/t' || doc_id || '.ts' path,
        text FROM documents, num),
pag AS (SELECT page_id k, 'p' || (page_id % n) project, 'src/pages/v' || page_id || '.ts' path,
        html FROM pages, num),
prj AS (SELECT 'p' || s_suppkey project, CASE s_suppkey % 5 WHEN 0 THEN 'typeorm'
        WHEN 1 THEN 'sequelize' WHEN 2 THEN 'mongoose' WHEN 3 THEN 'typeorm' END kind FROM supplier WHERE s_suppkey % 10 <> 9),
"""


def _values(rows: list[tuple], names: str) -> str:
    def lit(v) -> str:
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v).lower() if isinstance(v, bool) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) t({names})"


def _k(column: str) -> str:
    return f"replace({column}, '#', sup.k::VARCHAR)"


# ----- classes, members, edges ---------------------------------------------------------

SUP_CLASSES = ["Leaf#", "Crate#", "Pair#", "S#Controller", "Second#Controller"]
CLS = f"""
cls AS (
  SELECT project, path, 0 class_pos, 'C' || k AS name, CASE WHEN k % 10 = 0 THEN 'class' ELSE 'entity' END kind FROM cust
  UNION ALL SELECT project, path, 1, 'H' || k, 'entity' FROM cust WHERE k % 2 = 1
  UNION ALL SELECT project, path, 0, 'O' || k, 'entity' FROM ord
  UNION ALL SELECT project, dto, 0, 'D' || k, 'class' FROM par
  UNION ALL SELECT project, path, 0, 'P' || k || 'Controller', 'class' FROM par
  UNION ALL SELECT project, path, pos, {_k('nm')}, 'class' FROM sup, {_values(list(enumerate(SUP_CLASSES)), 'pos, nm')}
  UNION ALL SELECT project, far, 0, 'Far' || k, 'class' FROM sup
  UNION ALL SELECT project, path, 0, 'T' || k, 'class' FROM doc
  UNION ALL SELECT project, path, 0, 'V' || k, 'class' FROM pag
  UNION ALL SELECT project, path, 0, 'B' || k, 'entity' FROM bro
  UNION ALL SELECT project, path, 1, 'Rest' || k, 'entity' FROM bro),
mth AS (
  SELECT project, path, 0 class_pos, 0 pos, 0 file_pos, 'total' AS name, '' params, 'number' ret FROM cust
  UNION ALL SELECT project, path, 0, 0, 0, 'total', 'tax: number, rate: number', 'Promise<number>' FROM ord
  UNION ALL SELECT project, path, 0, 0, 0, 'get' || k, 'id: string', 'Promise<D' || k || '>' FROM par
  UNION ALL SELECT project, path, 3, 0, 0, 'helper', 'a: number', 'string' FROM sup
  UNION ALL SELECT project, path, 4, 0, 1, 'no', 'id: string', 'string' FROM sup
  UNION ALL SELECT project, path, 0, 0, 0, 'size', '', 'number' FROM doc
  UNION ALL SELECT project, path, 0, 0, 0, 'count', 'a: number', 'number' FROM bro
  UNION ALL SELECT project, path, 1, 0, 1, 'after', '', 'string' FROM bro),
prp AS (
  SELECT project, path, 0 class_pos, pos, nm AS name, CASE nm WHEN 'nation' THEN 'N' || n ELSE ty END AS type, dec
    FROM cust, {_values([(0, 'id', 'number', 'PrimaryGeneratedColumn'), (1, 'name', 'string', 'Column'), (2, 'nation', '', 'ManyToOne,JoinColumn')], 'pos, nm, ty, dec')}
  UNION ALL SELECT project, path, 0, 0, 'key', 'number', 'PrimaryColumn' FROM ord
  UNION ALL SELECT project, path, 0, 1, 'customer', 'C' || c, 'ManyToOne' FROM ord
  UNION ALL SELECT project, path, 0, 2, 'lines', 'L' || k || '[]', 'OneToMany' FROM ord
  UNION ALL SELECT project, path, 0, 0, 'body', 'string', 'Column' FROM doc
  UNION ALL SELECT project, path, 0, 0, 'page', 'string', 'Column' FROM pag
  UNION ALL SELECT project, path, 0, 0, 'z', 'string', 'Column' FROM bro
  UNION ALL SELECT project, path, 0, 1, 'owner', 'C' || k, 'ManyToOne' FROM bro),
edg AS (
  SELECT project, path, 0 class_pos, 2 property_pos, 0 pos, 'C' || k AS "from", 'N' || n AS "to", 'ManyToOne' AS type FROM cust WHERE k % 10 <> 0
  UNION ALL SELECT project, path, 0, 1, 0, 'O' || k, 'C' || c, 'ManyToOne' FROM ord
  UNION ALL SELECT project, path, 0, 2, 0, 'O' || k, 'L' || k, 'OneToMany' FROM ord
  UNION ALL SELECT project, path, 0, 1, 0, 'B' || k, 'C' || k, 'ManyToOne' FROM bro),
ife AS (
  SELECT project, path, 0 class_pos, pos property_pos, 0 pos, 'IUser' || u AS "from", replace(replace(nm, '#', u::VARCHAR), '%', v::VARCHAR) AS "to", ty AS type
    FROM usr, {_values([(1, 'IUser%', 'Ref'), (2, 'ITag#', 'RefArray'), (3, 'IUser%', 'Ref')], 'pos, nm, ty')}),
rou AS (
  SELECT project, path, 0 pos, 'get' || k AS name, 'GET' AS method, s::VARCHAR route, 'id: string' params, 'Promise<D' || k || '>' return_type FROM par
  UNION ALL SELECT project, path, 0, 'helper', 'PATCH', 'x', 'a: number', 'string' FROM sup
  UNION ALL SELECT project, path, 1, 'no', 'GET', 'no', 'id: string', 'string' FROM sup),
"""
IO = "'Input: (' || params || ')' || chr(10) || 'Output: ' || {}"
CLASS_COLS = (
    "project, path, class_pos::INT class_pos, name, kind, '/' || path file_path, "
    f"'{CLASS_DOCS}' docs"
)
FULL = (
    "async full(@Param('id') id: string, @Body() body: Pair#, @Query('m') mode: 'a' | 'b', "
    "plain: number): Promise<Pair#[]> { if (id === '}') { return [{ a: 1 }, { b: 2 }] as any"
)
SHAPES_HEAD = (
    "'shapes' }) export class S#Controller { constructor(private readonly s: Service) {}  "
    "@Put('/full/:id') " + FULL
)
SUP_STATEMENTS = [
    (0, "@Controller({ path: " + SHAPES_HEAD + "; } "),
    (1, "@Delete() drop(@Query('kind') kind: Mode#, @Query('again') again: any): void { return; "),
    (2, "@Patch('x') nothing() { return 1; "),
    (3, "@Controller('second') export class Second#Controller { @Get('no') no(id: string): string { return ''; "),
]
SUP_RAW = [
    (0, "path", SHAPES_HEAD, "Controller"),
    (1, "kind", "Mode#, @Query('again') again: any): void { return", "Query"),
    (2, "id", "string): string { return ''", "Get"),
]
DOC_RAW = "''}'' }) // it''s \"{\" here body: string"
RAW_PROPERTIES = f"""
raw AS (
  SELECT project, path, pos, nm AS name, CASE WHEN pos = 2 THEN 'N' || n ELSE ty END AS type, dec FROM cust, {_values([(0, 'id', 'number', 'PrimaryGeneratedColumn'), (2, 'nation', '', 'JoinColumn')], 'pos, nm, ty, dec')}
  UNION ALL SELECT project, path, 1, CASE WHEN k % 2 = 1 THEN 'name' ELSE 'type' END, CASE WHEN k % 2 = 1 THEN 'string' ELSE '''varchar'' }}) name: string' END, 'Column' FROM cust
  UNION ALL SELECT project, path, 0, 'name', '''orders'' }}) export class O' || k || ' {{ @PrimaryColumn() key: number', 'Entity' FROM ord
  UNION ALL SELECT project, path, 1, 'customer', 'C' || c, 'ManyToOne' FROM ord
  UNION ALL SELECT project, path, 2, 'cascade', 'true }}) public lines: L' || k || '[]', 'OneToMany' FROM ord
  UNION ALL SELECT project, path, 0, 'id', 'string): Promise<D' || k || '> {{ return null', 'Get' FROM par
  UNION ALL SELECT project, path, 1, 'body', 'D' || k || ', @Param(''id'') id: string): Promise<void> {{ return null', 'Body' FROM par
  UNION ALL SELECT project, path, pos, nm, {_k('ty')}, dec FROM sup, {_values(SUP_RAW, 'pos, nm, ty, dec')}
  UNION ALL SELECT project, path, 0, 'comment', '{DOC_RAW}', 'Column' FROM doc
  UNION ALL SELECT project, path, 0, 'page', 'string', 'Column' FROM pag
  UNION ALL SELECT project, path, 0, 'z', 'string', 'Column' FROM bro
  UNION ALL SELECT project, path, 1, 'owner', 'C' || k, 'ManyToOne' FROM bro),
"""

# ----- types ---------------------------------------------------------------------------------

SUP_TYPES = [
    (1, "Leaf#", "class", 0, "v", "string"),
    (2, "Box#", "interface", 0, "leaf", "Leaf#"),
    (2, "Box#", "interface", 1, "n", "number"),
    (3, "Crate#", "class", 0, "leaf", "Leaf#"),
    (4, "Pair#", "class", 0, "left", "Box#"),
    (4, "Pair#", "class", 1, "right", "Crate#"),
    (4, "Pair#", "class", 2, "when", "Date"),
    (4, "Pair#", "class", 3, "tags", "string[]"),
    (4, "Pair#", "class", 4, "opt", "Leaf# | undefined"),
    (4, "Pair#", "class", 5, "list", "Array<Leaf#>"),
    (4, "Pair#", "class", 6, "meta", "{ a: string; b: Leaf# }"),
    (4, "Pair#", "class", 7, "mode", "Mode#"),
    (4, "Pair#", "class", 8, "far", "Near#"),
    (4, "Pair#", "class", 9, "self", "Pair#[]"),
]
FLD = f"""
fld AS (
  SELECT project, dto path, 1 type_pos, 'D' || k type_name, 'class' kind, pos, nm AS name, replace(replace(ty, '%', pk::VARCHAR), '#', k::VARCHAR) AS type
    FROM par, {_values([(0, 'size', 'number'), (1, 'parent', 'D%'), (2, 'kind', 'Kind#')], 'pos, nm, ty')}
  UNION ALL SELECT project, path, 0, 'IUser' || u, 'interface', pos, nm, replace(replace(ty, '%', v::VARCHAR), '#', u::VARCHAR)
    FROM usr, {_values([(0, 'id', 'number'), (1, 'friend', 'IUser%'), (2, 'tags', '[ITag#]'), (3, 'list', 'IUser%[]')], 'pos, nm, ty')}
  UNION ALL SELECT project, path, tp, {_k('tn')}, kd, pos, nm, {_k('ty')} FROM sup, {_values(SUP_TYPES, 'tp, tn, kd, pos, nm, ty')}
  UNION ALL SELECT project, far, 0, 'Far' || k, 'class', 0, 'deep', 'string' FROM sup
  UNION ALL SELECT project, path, 0, 'C' || k, 'class', p.pos, p.name, p.type FROM cust JOIN prp p USING (project, path)
  UNION ALL SELECT project, path, 0, 'O' || k, 'class', p.pos, p.name, p.type FROM ord JOIN prp p USING (project, path)
  UNION ALL SELECT project, path, 0, 'T' || k, 'class', 0, 'body', 'string' FROM doc
  UNION ALL SELECT project, path, 0, 'V' || k, 'class', 0, 'page', 'string' FROM pag),
"""
IMP = """
imp AS (
  SELECT project, path, 0 pos, 'N' || n AS name, 'N' || n AS local, './n' || n || '.entity' module, 'src/entities/n' || n || '.entity.ts' target FROM cust
  UNION ALL SELECT project, dto, 0, 'D' || pk, 'D' || pk, './d' || pk || '.dto', 'src/dto/d' || pk || '.dto.ts' FROM par WHERE pk <> k
  UNION ALL SELECT project, path, 0, 'D' || k, 'D' || k, '../dto/d' || k || '.dto', dto FROM par
  UNION ALL SELECT project, path, 0, 'Controller', 'Controller', '@nestjs/common', NULL FROM sup
  UNION ALL SELECT project, path, 1, 'Put', 'Put', '@nestjs/common', NULL FROM sup
  UNION ALL SELECT project, path, 2, 'Far' || k, 'Near' || k, './far/f' || k || '.dto', far FROM sup),
"""
SUP_REFS = [
    ("Box#", "leaf", "Leaf#", "class"),
    ("Crate#", "leaf", "Leaf#", "class"),
    ("Pair#", "left", "Box#", "interface"),
    ("Pair#", "right", "Crate#", "class"),
    ("Pair#", "opt", "Leaf#", "class"),
    ("Pair#", "list", "Leaf#", "class"),
    ("Pair#", "mode", "Mode#", "enum"),
    ("Pair#", "self", "Pair#", "class"),
    ("{ a: string; b: Leaf# }", "b", "Leaf#", "class"),
    ("full", "body", "Pair#", "class"),
    ("full", "response", "Pair#", "class"),
]
REFS = f"""
  SELECT project, path, 'C' || k AS owner, 'nation' place, 'N' || n AS base, 'src/entities/n' || n || '.entity.ts' ref_path, 'N' || n AS ref_name, NULL::VARCHAR declared FROM cust
  UNION ALL SELECT project, path, 'O' || k, 'customer', 'C' || c, path, 'C' || c, NULL FROM ord
  UNION ALL SELECT project, path, 'O' || k, 'lines', 'L' || k, path, 'L' || k, NULL FROM ord
  UNION ALL SELECT project, dto, 'D' || k, 'parent', 'D' || pk, 'src/dto/d' || pk || '.dto.ts', 'D' || pk, 'class' FROM par
  UNION ALL SELECT project, dto, 'D' || k, 'kind', 'Kind' || k, dto, 'Kind' || k, 'enum' FROM par
  UNION ALL SELECT project, path, 'get' || k, 'response', 'D' || k, dto, 'D' || k, 'class' FROM par
  UNION ALL SELECT project, path, 'put' || k, 'body', 'D' || k, dto, 'D' || k, 'class' FROM par
  UNION ALL SELECT project, path, 'IUser' || u, pl, 'IUser' || v, path, 'IUser' || v, CASE WHEN v IN (SELECT u FROM usr) AND false THEN '' END FROM usr, {_values([('friend',), ('list',)], 'pl')}
  UNION ALL SELECT project, path, {_k('ow')}, pl, {_k('ba')}, path, {_k('ba')}, de FROM sup, {_values(SUP_REFS, 'ow, pl, ba, de')}
  UNION ALL SELECT project, path, 'Pair' || k, 'far', 'Near' || k, far, 'Far' || k, 'class' FROM sup
"""
# node, depth, field, type text, kind, type name, is array, printed lines
SUP_NODES = [
    ("0", 1, "left", "Box#", "object", "Box#", False, "- left: Box#"),
    ("0.0", 2, "leaf", "Leaf#", "object", "Leaf#", False, "- leaf: Leaf#"),
    ("0.0.0", 3, "v", "string", "text", "", False, "- v: string"),
    ("0.1", 2, "n", "number", "text", "", False, "- n: number"),
    ("1", 1, "right", "Crate#", "object", "Crate#", False, "- right: Crate#"),
    ("1.0", 2, "leaf", "Leaf#", "object", "Leaf#", False, "- leaf: Leaf# (circular ref)"),
    ("1.0.0", 3, "v", "string", "text", "", False, ""),
    ("2", 1, "when", "Date", "text", "", False, "- when: Date"),
    ("3", 1, "tags", "string[]", "text", "", True, "- tags: string[]"),
    ("4", 1, "opt", "Leaf# | undefined", "object", "Leaf#", False, "- opt: Leaf#"),
    ("4.0", 2, "v", "string", "text", "", False, "- v: string"),
    ("5", 1, "list", "Array<Leaf#>", "object", "Leaf#", True, "- list: Leaf#"),
    ("5.0", 2, "v", "string", "text", "", False, "- v: string"),
    ("6", 1, "meta", "{ a: string; b: Leaf# }", "object", "__type", False, "- meta: __type"),
    ("6.0", 2, "a", "string", "text", "", False, "- a: string"),
    ("6.1", 2, "b", "Leaf#", "object", "Leaf#", False, "- b: Leaf#"),
    ("6.1.0", 3, "v", "string", "text", "", False, "- v: string"),
    ("7", 1, "mode", "Mode#", "enum", "Mode#", False, "- mode: Mode# (enum)\n  • ON\n  • OFF"),
    ("8", 1, "far", "Near#", "object", "Far#", False, "- far: Far#"),
    ("8.0", 2, "deep", "string", "text", "", False, "- deep: string"),
    ("9", 1, "self", "Pair#[]", "circular", "Pair#", True, "- self: Pair# (circular ref)"),
]
NODES = f"""
chain AS (
  SELECT k root, k cur, pk, project, dto root_path, '' pre, 1 depth FROM par
  UNION ALL SELECT c.root, p.k, p.pk, c.project, c.root_path, c.pre || '1.', c.depth + 1
    FROM chain c JOIN par p ON p.k = c.pk WHERE c.pk <> c.cur),
nod AS (
  SELECT project, root_path, 'D' || root root_name, pre || '0' node, depth, 'size' field, 'number' type_text, 'text' kind, '' type_name, false is_array, '- size: number' lines FROM chain
  UNION ALL SELECT project, root_path, 'D' || root, pre || '1', depth, 'parent', 'D' || pk, CASE WHEN pk = cur THEN 'circular' ELSE 'object' END, 'D' || pk, false, '- parent: D' || pk || CASE WHEN pk = cur THEN ' (circular ref)' ELSE '' END FROM chain
  UNION ALL SELECT project, root_path, 'D' || root, pre || '2', depth, 'kind', 'Kind' || cur, 'enum', 'Kind' || cur, false, '- kind: Kind' || cur || ' (enum)' || chr(10) || '  • SMALL' || chr(10) || '  • LARGE' FROM chain
  UNION ALL SELECT project, path, 'Pair' || k, nd, dp, fi, {_k('tt')}, kd, {_k('tn')}, ar, {_k('li')} FROM sup, {_values(SUP_NODES, 'nd, dp, fi, tt, kd, tn, ar, li')}),
tli AS (
  SELECT project, root_path, root_name, node, depth - 1 indent, unnest(range(len(string_split(lines, chr(10))))) line, unnest(string_split(lines, chr(10))) text, kind, type_name, is_array, field
    FROM nod WHERE lines <> ''),
"""
TREE_COLS = "project, root_path, root_name, node, line::INT line, indent::INT indent, text"

# ----- endpoints --------------------------------------------------------------------------------

END = """
epd AS (
  SELECT project, path, 0 pos, 'P' || k || 'Controller' controller, 'GET parts/' || s route, 'get' || k method_name, 'Promise<D' || k || '>' return_type, 'D' || k response FROM par
  UNION ALL SELECT project, path, 1, 'P' || k || 'Controller', 'POST parts/', 'put' || k, 'Promise<void>', 'void' FROM par
  UNION ALL SELECT project, path, 0, 'S' || k || 'Controller', 'PUT { path: shapes }/full/:id', 'full', 'Promise<Pair' || k || '[]>', 'Pair' || k || '[]' FROM sup
  UNION ALL SELECT project, path, 1, 'S' || k || 'Controller', 'DELETE { path: shapes }/', 'drop', 'void', 'void' FROM sup
  UNION ALL SELECT project, path, 2, 'S' || k || 'Controller', 'PATCH { path: shapes }/x', 'nothing', '', '' FROM sup),
epp AS (
  SELECT project, path, 1 pos, 'put' || k method_name, 0 param_pos, 'body' AS key, 'body' AS name, 'D' || k AS type, 'D' || k AS shown FROM par
  UNION ALL SELECT project, path, 1, 'put' || k, 1, 'param', 'id', 'string', 'id (string)' FROM par
  UNION ALL SELECT project, path, 0, 'full', 0, 'param', 'id', 'string', 'id (string)' FROM sup
  UNION ALL SELECT project, path, 0, 'full', 1, 'body', 'body', 'Pair' || k, 'Pair' || k FROM sup
  UNION ALL SELECT project, path, 0, 'full', 2, 'query', 'mode', '''a'' | ''b''', 'mode (''a'' | ''b'')' FROM sup
  UNION ALL SELECT project, path, 1, 'drop', 0, 'query', 'again', 'any', 'any (primitive)' FROM sup),
uses AS (
  SELECT project, path, 0 pos, -1 slot, dto root_path, 'D' || k root_name FROM par
  UNION ALL SELECT project, path, 1, 0, dto, 'D' || k FROM par
  UNION ALL SELECT project, path, 0, 1, path, 'Pair' || k FROM sup
  UNION ALL SELECT project, path, 0, -1, path, 'Pair' || k FROM sup),
"""
ENDPOINT_LINES = """
  SELECT project, 6 section, 1 part, path, pos || '.0' ord, 0 line, 'heading2' style, 'Endpoint: ' || route AS text FROM epd
  UNION ALL SELECT project, 6, 1, path, pos || '.0', 1, 'quote', 'Controller: ' || controller || ' → Method: ' || method_name FROM epd
  UNION ALL SELECT DISTINCT project, 6, 1, path, pos || '.0', 2, 'normal', 'Request Params:' FROM epp
  UNION ALL SELECT project, 6, 1, path, pos || '.1.' || param_pos, 0, 'courier', '- ' || key || ': ' || shown FROM epp
  UNION ALL SELECT project, 6, 1, path, pos || '.2', 0, 'normal', 'Response:' FROM uses WHERE slot = -1
  UNION ALL SELECT u.project, 6, 1, u.path, u.pos || CASE WHEN slot < 0 THEN '.2.0.' ELSE '.1.' || slot || '.' END || t.node, t.line::INT, 'courier', repeat('  ', (CASE WHEN slot < 0 THEN 1 ELSE 2 END + t.indent)::INT) || t.text
    FROM uses u JOIN tli t USING (project, root_path, root_name)
  UNION ALL SELECT project, 6, 1, path, pos || '.3', 0, 'normal', '' FROM epd
"""

# ----- diagrams and documents ----------------------------------------------------------------------

_SYMBOLS = _values(SYMBOLS, "type, symbol")
ALL_EDGES = f"""
pre AS (
  SELECT e.* FROM edg e JOIN prj USING (project) WHERE prj.kind = 'typeorm'
  UNION ALL SELECT e.* FROM ife e JOIN prj USING (project) WHERE prj.kind = 'mongoose'),
dra AS (SELECT pre.*, s.symbol, '    ' || "from" || ' ' || symbol || ' ' || "to" || ' : ""' line
        FROM pre JOIN (SELECT * FROM {_SYMBOLS}) s USING (type)),
spr AS (SELECT project, project IN (SELECT project FROM pre) has FROM prj WHERE kind IS NOT NULL),
"""
ERD_LINES = f"""
  SELECT project, 4 section, 0 part, '' path, '1' ord, 0 line, 'courier' style, 'erDiagram' AS text FROM spr
  UNION ALL SELECT project, 4, 0, '', '1', 1, 'courier', '    %% No relationships found' FROM spr WHERE NOT has
  UNION ALL SELECT project, 4, 0, path, '1.' || class_pos || '.' || property_pos || '.' || pos, 0, 'courier', line FROM dra
  UNION ALL SELECT project, 4, 1, '', '', 0, 'quote', '{ERD_HINT}' FROM spr
"""
ERD_TEXT = """
  SELECT project, '' path, CASE WHEN has THEN 'erDiagram' || chr(10) ELSE 'erDiagram' || chr(10) || '    %% No relationships found' END AS text FROM spr
  UNION ALL SELECT project, path, string_agg(line || chr(10), '' ORDER BY class_pos, property_pos, pos) FROM dra GROUP BY project, path
"""
ENT = """
ent AS (
  SELECT c.project, c.path, c.class_pos pos, c.name FROM cls c JOIN prj USING (project) WHERE c.kind = 'entity' AND prj.kind = 'typeorm'),
enp AS (
  SELECT e.project, e.path, e.pos, p.pos ppos, p.name, p.type, replace(p.dec, ',', ', ') dec FROM ent e JOIN prp p ON p.project = e.project AND p.path = e.path AND p.class_pos = e.pos
  UNION ALL SELECT f.project, f.path, f.type_pos, f.pos, f.name, f.type, '' FROM fld f JOIN prj USING (project) WHERE f.kind = 'interface' AND prj.kind = 'mongoose'),
ena AS (SELECT * FROM ent UNION ALL SELECT DISTINCT f.project, f.path, f.type_pos, f.type_name FROM fld f JOIN prj USING (project) WHERE f.kind = 'interface' AND prj.kind = 'mongoose'),
"""
ENTITY_TABLES = f"""
  SELECT project, 4 section, 2 part, path, pos::VARCHAR ord, 0 line, 'heading2' style, 'Entity: ' || name AS text FROM ena
  UNION ALL SELECT project, 4, 2, path, pos::VARCHAR, 1, 'table', '{TABLE_HEADER}' FROM ena
  UNION ALL SELECT project, 4, 2, path, pos::VARCHAR, 2 + ppos, 'table', name || ' | ' || type || ' | ' || dec FROM enp
"""
CLASS_LINES = f"""
  SELECT project, 5 section, 1 part, path, class_pos::VARCHAR ord, 0 line, 'heading2' style, 'Class: ' || name AS text FROM cls WHERE kind = 'class'
  UNION ALL SELECT project, 5, 1, path, class_pos::VARCHAR, 1, 'normal', '{CLASS_DOCS}' FROM cls WHERE kind = 'class'
  UNION ALL SELECT m.project, 5, 1, m.path, class_pos::VARCHAR, 2 + 3 * m.pos + i, CASE i WHEN 0 THEN 'heading3' ELSE 'normal' END,
    CASE i WHEN 0 THEN 'Method: ' || m.name WHEN 1 THEN 'Input: (' || params || ')' ELSE 'Output: ' || ret END
    FROM mth m JOIN cls USING (project, path, class_pos), range(3) r(i) WHERE cls.kind = 'class'
"""
FUNCTION_LINES = """
  SELECT project, 5 section, 2 part, path, pos::VARCHAR ord, i::INT line, CASE i WHEN 0 THEN 'heading2' ELSE 'normal' END style,
    CASE i WHEN 0 THEN 'Function: ' || name WHEN 1 THEN 'Input: (' || params || ')' ELSE 'Output: ' || return_type END AS text
    FROM rou, range(3) r(i)
"""
HEADINGS = [
    (1, 0, "title", "📘 Project Documentation"),
    (1, 1, "quote", "Project: Project Documentation"),
    (1, 2, "quote", "Generated on: 2024-01-31"),
    (2, 0, "heading1", "Table of Contents"),
    (3, 0, "heading1", "Folder Structure"),
    (4, 0, "heading1", "Database Schema"),
    (4, 1, "heading2", "Mermaid ER Diagram Syntax"),
    (5, 0, "heading1", "Class & Function Details"),
    (6, 0, "heading1", "API Endpoints"),
]
ALL_PATHS = """
fil AS (
  SELECT project, path FROM cust UNION ALL SELECT project, path FROM ord UNION ALL SELECT project, path FROM par
  UNION ALL SELECT project, dto FROM par UNION ALL SELECT project, path FROM usr UNION ALL SELECT project, path FROM sup
  UNION ALL SELECT project, far FROM sup UNION ALL SELECT project, path FROM doc UNION ALL SELECT project, path FROM pag
  UNION ALL SELECT project, path FROM bro
  UNION ALL SELECT project, 'src/s' || k || '.d.ts' FROM sup UNION ALL SELECT project, 'README.md' FROM sup
  UNION ALL SELECT project, 'prisma/schema.prisma' FROM sup WHERE k % 7 = 0),
tnd AS (
  SELECT DISTINCT project, array_to_string(parts[1:i], '/') node, i depth, parts[i] AS name, array_to_string(parts[1:i-1], '/') parent
  FROM (SELECT project, string_split(path, '/') parts, unnest(range(1, len(string_split(path, '/')) + 1)) i FROM fil)),
tfl AS (SELECT *, name = max(name) OVER (PARTITION BY project, parent) is_last FROM tnd),
tre AS (
  SELECT t.project, t.node, t.depth, t.name, coalesce(string_agg(CASE WHEN a.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY a.depth) FILTER (a.depth IS NOT NULL), '')
      || CASE WHEN t.is_last THEN '└── ' ELSE '├── ' END || t.name AS line
    FROM tfl t LEFT JOIN tfl a ON a.project = t.project AND a.depth < t.depth AND starts_with(t.node, a.node || '/')
    GROUP BY t.project, t.node, t.depth, t.name, t.is_last
  UNION ALL SELECT project, '', 0, project, project FROM sup),
"""


def _all_lines() -> str:
    docs = " UNION ALL ".join(
        f"SELECT l.* FROM ({q}) l JOIN prj USING (project) WHERE prj.kind {test}"
        for q, test in [
            (ENTITY_TABLES, "IS NOT NULL"),
            (CLASS_LINES, "= 'typeorm'"),
            (FUNCTION_LINES, "= 'typeorm'"),
            (ENDPOINT_LINES, "IS NOT NULL"),
        ]
    )
    return f"""
  SELECT prj.project, se section, 0 part, '' path, '' ord, li line, st style, tx AS text FROM prj, {_values(HEADINGS, 'se, li, st, tx')} WHERE kind IS NOT NULL
  UNION ALL SELECT tre.project, 3, 1, tre.node, '', 0, 'courier', tre.line FROM tre JOIN prj USING (project) WHERE kind IS NOT NULL
  UNION ALL SELECT * FROM ({ERD_LINES})
  UNION ALL SELECT * FROM ({docs})
"""


# ----- catalogue documents --------------------------------------------------------------------------


def _json_list(items: str, order: str) -> str:
    return f"'[' || coalesce(string_agg({items}, ',' ORDER BY {order}), '') || ']'"


_METHOD_JSON = f"""'{{"name":' || to_json(m.name) || ',"docs":' || to_json({IO.format('m.ret').replace('params', 'm.params')}) || ',"returnType":' || to_json(m.ret) || '}}'"""
_PROPERTY_JSON = """'{"name":' || to_json(p.name) || ',"type":' || to_json(p.type) || ',"decorators":' || to_json(CASE WHEN p.dec = '' THEN [] ELSE string_split(p.dec, ',') END) || '}'"""
CATALOGUE = f"""
  cjs AS (
    SELECT c.project, c.path, c.class_pos pos, c.kind,
      '{{"name":' || to_json(c.name) || ',"filePath":' || to_json('/' || c.path) || ',"docs":' || to_json('{CLASS_DOCS}') ||
      ',"methods":' || coalesce((SELECT {_json_list(_METHOD_JSON, 'm.pos')} FROM mth m WHERE m.project = c.project AND m.path = c.path AND m.class_pos = c.class_pos), '[]') ||
      ',"properties":' || coalesce((SELECT {_json_list(_PROPERTY_JSON, 'p.pos')} FROM prp p WHERE p.project = c.project AND p.path = c.path AND p.class_pos = c.class_pos), '[]') || '}}' js
    FROM cls c JOIN prj USING (project) WHERE prj.kind = 'typeorm'
  ), ijs AS (
    SELECT f.project, f.path, f.type_pos pos,
      '{{"name":' || to_json(f.type_name) || ',"filePath":' || to_json('/' || f.path) || ',"docs":' || to_json('{INTERFACE_DOCS}') || ',"methods":[],"properties":' ||
      '[' || string_agg('{{"name":' || to_json(f.name) || ',"type":' || to_json(f.type) || ',"decorators":[]}}', ',' ORDER BY f.pos) || ']}}' js
    FROM fld f JOIN prj USING (project) WHERE f.kind = 'interface' AND prj.kind = 'mongoose' GROUP BY f.project, f.path, f.type_pos, f.type_name
  ), ejs AS (
    SELECT project, path, '[' || string_agg('{{"from":' || to_json("from") || ',"to":' || to_json("to") || ',"type":' || to_json(type) || '}}', ',' ORDER BY class_pos, property_pos, pos) || ']' js
    FROM (SELECT * FROM edg UNION ALL SELECT * FROM ife) GROUP BY project, path
  ), rjs AS (
    SELECT project, path, '[' || string_agg('{{"name":' || to_json(name) || ',"method":' || to_json(method) || ',"route":' || to_json(route) || ',"docs":' || to_json({IO.format('return_type')}) || ',"returnType":' || to_json(return_type) || '}}', ',' ORDER BY pos) || ']' js
    FROM rou GROUP BY project, path
  ), alljs AS (
    SELECT project, '' path, '[]' en, '[]' cl, '[]' fu, '[]' re FROM prj WHERE kind IS NOT NULL
    UNION ALL
    SELECT c.project, c.path, '[' || coalesce(string_agg(c.js, ',' ORDER BY c.pos) FILTER (c.kind = 'entity'), '') || ']',
      '[' || coalesce(string_agg(c.js, ',' ORDER BY c.pos) FILTER (c.kind = 'class'), '') || ']', coalesce(any_value(r.js), '[]'), coalesce(any_value(e.js), '[]')
    FROM cjs c LEFT JOIN rjs r USING (project, path) LEFT JOIN ejs e USING (project, path) GROUP BY c.project, c.path
    UNION ALL
    SELECT i.project, i.path, '[' || string_agg(i.js, ',' ORDER BY i.pos) || ']', '[]', '[]', coalesce(any_value(e.js), '[]')
    FROM ijs i LEFT JOIN ejs e USING (project, path) GROUP BY i.project, i.path
  ),
"""
PROJECT_JSON_ROWS = """
  SELECT project, path, '{"entities":' || en || ',"classes":' || cl || ',"functions":' || fu || ',"relationships":' || re || '}' AS json FROM alljs
"""
PARSED_JSON = """
          SELECT project, '' path, true valid, 0 n_entities, 0 n_classes, 0 n_functions, 0 n_relationships, '' entity_names FROM prj WHERE kind IS NOT NULL
          UNION ALL SELECT c.project, c.path, true, sum((c.kind = 'entity')::INT)::INT, sum((c.kind = 'class')::INT)::INT, coalesce(any_value(nr), 0)::INT, coalesce(any_value(ne), 0)::INT, coalesce(string_agg(c.name, ',' ORDER BY class_pos) FILTER (c.kind = 'entity'), '')
            FROM cls c JOIN prj USING (project) LEFT JOIN (SELECT project, path, count(*) nr FROM rou GROUP BY ALL) USING (project, path) LEFT JOIN (SELECT project, path, count(*) ne FROM edg GROUP BY ALL) USING (project, path) WHERE prj.kind = 'typeorm' GROUP BY c.project, c.path
          UNION ALL SELECT f.project, f.path, true, count(DISTINCT type_name)::INT, 0, 0, coalesce(any_value(ni), 0)::INT, any_value(type_name) FROM fld f JOIN prj USING (project) LEFT JOIN (SELECT project, path, count(*) ni FROM ife GROUP BY ALL) USING (project, path) WHERE f.kind = 'interface' AND prj.kind = 'mongoose' GROUP BY f.project, f.path"""


CUSTOMER_TEXT = """import { N% } from './n%.entity';

@@class C# {
  @PrimaryGeneratedColumn()
  id: number;

  ^
  name: string;

  @ManyToOne(() => N%)
  @JoinColumn()
  nation: N%;

  total(): number {
    const plain = this.name.replace(/\\(/g, '').replace(/[{]/g, "'");
    return 1;
  }
}"""

LINE_COLS = "project, section::INT section, part::INT part, path, ord, line::INT line, style, text"


# ----- names handed on by modules -------------------------------------------------------------------------

MOD = """
mod AS (
  SELECT p_partkey k, n, 'p' || (p_partkey % n) project, (p_partkey // n) % 3 step, p_partkey - ((p_partkey // n) % 3) * n j,
    'src/lib/m' || p_partkey || '/model.ts' model, 'src/lib/m' || p_partkey || '/index.ts' idx, 'src/lib/m' || p_partkey || '/loop.ts' loop,
    'src/lib/m' || p_partkey || '.barrel.ts' barrel, 'src/app/u' || p_partkey || '.controller.ts' usr,
    'src/lib/m' || (p_partkey - ((p_partkey // n) % 3) * n) || '/model.ts' first
  FROM part, num),
pub AS (
  SELECT k, project, replace(nm, '#', k::VARCHAR) AS name, CASE WHEN nm = 'Only#' THEN loop ELSE model END decl_path, replace(de, '#', k::VARCHAR) decl_name
  FROM mod, (VALUES ('Model#', 'M#'), ('Maybe#', 'Maybe#'), ('Rows#', 'Rows#'), ('Box#', 'Box#'), ('Id#', 'Id#'), ('Ring#', 'Ring#'), ('Odd#', 'Odd#'),
    ('Main#', 'Main#'), ('Only#', 'Only#')) t(nm, de)),
"""
EXPORTS = """
  SELECT project, model AS path, nm || CASE WHEN nm = 'default' THEN '' ELSE k::VARCHAR END AS name, model decl_path,
    CASE WHEN nm = 'default' THEN 'Main' ELSE nm END || k decl_name
    FROM mod, (VALUES ('M'), ('default'), ('Maybe'), ('Rows'), ('Box'), ('Id'), ('Ring'), ('Odd')) t(nm)
  UNION ALL SELECT m.project, unnest([m.idx, m.loop]), p.name, p.decl_path, p.decl_name FROM mod m JOIN pub p USING (k)
  UNION ALL SELECT m.project, m.barrel, p.name, p.decl_path, p.decl_name FROM mod m JOIN pub p ON p.k <= m.k AND p.k >= m.j AND p.project = m.project
  UNION ALL SELECT project, usr, unnest(['Use' || k, 'U' || k || 'Controller']) x, usr, x FROM mod
"""
TARGETS = """
  SELECT project, idx AS path, './model' AS module, model AS target, true AS found FROM mod
  UNION ALL SELECT project, idx, './loop', loop, true FROM mod
  UNION ALL SELECT project, loop, './index', idx, true FROM mod
  UNION ALL SELECT project, barrel, './m' || k, idx, true FROM mod
  UNION ALL SELECT project, barrel, './m' || (k - n) || '.barrel', 'src/lib/m' || (k - n) || '.barrel.ts', true FROM mod WHERE step > 0
  UNION ALL SELECT project, usr, CASE WHEN (k // 2) % 2 = 0 THEN '@lib/m' ELSE '../lib/m' END || k || '.barrel', barrel, true FROM mod
  UNION ALL SELECT project, usr, '../lib/m' || k || '/model', model, true FROM mod
  UNION ALL SELECT project, usr, '@nestjs/common', NULL, false FROM mod
"""
MODULE_REFS = """
  SELECT project, model AS path, ow || k AS owner, pl place, 'M' || k AS base, model AS ref_path, 'M' || k AS ref_name, 'class' AS declared
    FROM mod, (VALUES ('M', 'twin'), ('Main', 'm'), ('Box', 'item')) t(ow, pl)
  UNION ALL SELECT project, model, 'Box' || k, 'more', 'T', model, 'T', NULL FROM mod
  UNION ALL SELECT project, model, '{ deep: M' || k || ' }', 'deep', 'M' || k, model, 'M' || k, 'class' FROM mod
  UNION ALL SELECT project, usr, 'Use' || k, 'model', 'Model' || j, first, 'M' || j, 'class' FROM mod
  UNION ALL SELECT project, usr, 'Use' || k, 'first', 'First', first, 'Main' || j, 'class' FROM mod
  UNION ALL SELECT project, usr, 'Use' || k, 'only', 'Only' || k, loop, 'Only' || k, 'class' FROM mod
  UNION ALL SELECT project, usr, 'Use' || k, 'rows', 'M' || k, model, 'M' || k, 'class' FROM mod
  UNION ALL SELECT project, usr, 'Use' || k, 'box', 'Box' || k, model, 'Box' || k, 'type' FROM mod
  UNION ALL SELECT project, usr, 'Use' || k, 'id', 'string', NULL, NULL, NULL FROM mod
  UNION ALL SELECT project, usr, 'Use' || k, 'ring', 'Ring' || k, model, 'Ring' || k, NULL FROM mod
  UNION ALL SELECT project, usr, 'Use' || k, 'odd', '{ deep: M' || k || ' }', model, '{ deep: M' || k || ' }', 'inline' FROM mod
  UNION ALL SELECT project, usr, 'Use' || k, 'plain', 'Plain', model, 'Main' || k, 'class' FROM mod
  UNION ALL SELECT project, usr, 'Use' || k, 'space', 'all.M' || k, model, 'M' || k, 'class' FROM mod
  UNION ALL SELECT project, usr, 'Use' || k, 'out', 'Injectable', NULL, 'Injectable', NULL FROM mod
  UNION ALL SELECT project, usr, 'make', 'body', 'Use' || k, usr, 'Use' || k, 'class' FROM mod
  UNION ALL SELECT project, usr, 'make', 'response', 'Model' || j, first, 'M' || j, 'class' FROM mod
"""
# # stands for the part, @ for the first one of its chain; what is marked is there only where these differ
MODULE_LINES = [
    ("0", "model: M@", ""), ("0.0", "v: string", ""), ("0.1", "twin: M@ (circular ref)", ""),
    ("1", "first: Main@", ""), ("1.0", "m: M@", ""), ("1.0.0", "v: string", ""), ("1.0.1", "twin: M@ (circular ref)", ""),
    ("2", "only: Only#", ""), ("2.0", "z: number", ""),
    ("3", "rows: M#", ""), ("3.0", "v: string", ""), ("3.1", "twin: M# (circular ref)", ""),
    ("4", "box: Box#", ""), ("4.0", "item: M#", ""), ("4.0.0", "v: string", ""), ("4.0.1", "twin: M# (circular ref)", ""), ("4.1", "more: T", ""),
    ("5", "id: Id#", ""), ("6", "ring: Ring#", ""),
    ("7", "odd: __type", ""), ("7.0", "deep: M#", ""), ("7.0.0", "v: string", ""), ("7.0.1", "twin: M# (circular ref)", ""),
    ("8", "plain: Main#", ""), ("8.0", "m: M#", "other"), ("8.0.0", "v: string", "other"), ("8.0.1", "twin: M# (circular ref)", "other"),
    ("8.0", "m: M# (circular ref)", "same"),
    ("9", "space: M#", ""), ("9.0", "v: string", ""), ("9.1", "twin: M# (circular ref)", ""), ("10", "out: Injectable", ""),
]
MODULE_TREES = f"""
  SELECT project, usr root_path, 'Use' || k root_name, no AS node, 0 AS line, len(string_split(no, '.'))::INT - 1 AS indent,
    '- ' || replace(replace(tx, '#', k::VARCHAR), '@', j::VARCHAR) AS text
    FROM mod, {_values(MODULE_LINES, 'no, tx, wh')} WHERE wh = '' OR (wh = 'same') = (j = k)
  UNION ALL SELECT project, model, 'M' || k, no, 0, 0, '- ' || replace(tx, '#', k::VARCHAR)
    FROM mod, (VALUES ('0', 'v: string'), ('1', 'twin: M# (circular ref)')) t(no, tx) WHERE j = k
"""


# ----- types in rings ---------------------------------------------------------------------------------------

RIN = """
rin AS (
  SELECT p_partkey k, p_partkey // 3 g, p_partkey // 12 c, 'p' || ((p_partkey // 12) % n) project, 'src/ring/r' || p_partkey || '.ts' AS path,
    lead(p_partkey) OVER (PARTITION BY p_partkey // 12 ORDER BY p_partkey) aft, min(p_partkey) OVER (PARTITION BY p_partkey // 3) fst,
    2.0::DOUBLE ** (dense_rank() OVER (PARTITION BY p_partkey // 12 ORDER BY p_partkey // 3) - 1) n_paths
  FROM part, num),
"""
CYCLES = """
  SELECT project, path, 'R' || k AS name, min(path) OVER ring cycle_path, min_by('R' || k, path) OVER ring cycle_name, count(*) OVER ring n_types
  FROM rin WINDOW ring AS (PARTITION BY g)
"""
SHARED = """
  SELECT project, path, 'R' || k AS name, 0 pos, 'next' AS field, 'R' || nx type_text, 'cycle' kind, 'src/ring/r' || nx || '.ts' ref_path, 'R' || nx ref_name, n_paths
    FROM (SELECT *, CASE WHEN aft // 3 = g THEN aft ELSE fst END nx FROM rin)
  UNION ALL SELECT project, path, 'R' || k, 1, 'leaf', 'Leaf' || k, 'object', path, 'Leaf' || k, n_paths FROM rin
  UNION ALL SELECT project, path, 'R' || k, ps, fi, 'R' || aft || br, 'object', 'src/ring/r' || aft || '.ts', 'R' || aft, n_paths
    FROM rin, (VALUES (2, 'left', ''), (3, 'right', '[]')) t(ps, fi, br) WHERE aft // 3 <> g
  UNION ALL SELECT project, path, 'Leaf' || k, 0, 'v', 'string', 'text', NULL, NULL, n_paths FROM rin
"""


def _q(select: str, *ctes: str, recursive: bool = False) -> str:
    body = (FILES + "".join(ctes)).rstrip().rstrip(",")
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n{select}"


def oracle_sql() -> dict[str, str]:
    types_ctes = (CLS, FLD)
    trees = dict(recursive=True)
    everything = (CLS, FLD, NODES, END, ALL_EDGES, ENT, ALL_PATHS)
    numbered = """
      SELECT project, path, CASE WHEN k % 10 = 0 THEN '' ELSE '@Entity() export class C' || k || ' { ' END || '@PrimaryGeneratedColumn() id: number; ' AS statement, 0 pos FROM cust
      UNION ALL SELECT project, path, CASE WHEN k % 2 = 1 THEN '@Column() name: string; ' ELSE '@Column({ type: ''varchar'' }) name: string; ' END, 1 FROM cust
      UNION ALL SELECT project, path, '@ManyToOne(() => N' || n || ') @JoinColumn() nation: N' || n || '; ', 2 FROM cust
      UNION ALL SELECT project, path, '@Entity({ name: ''orders'' }) export class O' || k || ' { @PrimaryColumn() key: number; ', 0 FROM ord
      UNION ALL SELECT project, path, '@ManyToOne(() => C' || c || ', (c) => c.orders) customer: C' || c || '; ', 1 FROM ord
      UNION ALL SELECT project, path, '@OneToMany((t) => L' || k || ', (l) => l.order, { cascade: true }) public lines: L' || k || '[]; ', 2 FROM ord
      UNION ALL SELECT project, path, '@Controller(''parts'') export class P' || k || 'Controller { @Get(''' || s || ''') get' || k || '(id: string): Promise<D' || k || '> { return null; ', 0 FROM par
      UNION ALL SELECT project, path, '@Post() put' || k || '(@Body() body: D' || k || ', @Param(''id'') id: string): Promise<void> { return null; ', 1 FROM par
      UNION ALL SELECT project, path, '@Column({ comment: ''}'' }) // it''s "{" here body: string; ', 0 FROM doc
      UNION ALL SELECT project, path, '@Column() page: string; ', 0 FROM pag
      UNION ALL SELECT project, path, '@Entity() export class B' || k || ' { @Column() z: string; ', 0 FROM bro
      UNION ALL SELECT project, path, '@ManyToOne(() => C' || k || ') owner: C' || k || '; ', 1 FROM bro
    """ + f" UNION ALL SELECT project, path, {_k('tx')}, pos FROM sup, {_values(SUP_STATEMENTS, 'pos, tx')}"
    scan = """
      SELECT project, path FROM cust UNION ALL SELECT project, path FROM ord UNION ALL SELECT project, path FROM par
      UNION ALL SELECT project, dto FROM par UNION ALL SELECT project, path FROM usr UNION ALL SELECT project, path FROM sup
      UNION ALL SELECT project, far FROM sup UNION ALL SELECT project, path FROM doc UNION ALL SELECT project, path FROM pag
      UNION ALL SELECT project, path FROM bro"""
    out = {
        "detect_orm": _q("SELECT project, kind FROM prj"),
        "has_prisma_schema": "SELECT 'p' || s_suppkey project FROM supplier WHERE s_suppkey % 7 = 0",
        "validate_requests": """
          SELECT c_custkey request_id, project_path, CASE WHEN project_path IS NULL THEN NULL WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 10 = 2 THEN '   ' WHEN c_custkey % 10 = 3 THEN 'gone' || c_custkey ELSE 'p' || (c_custkey % n) END project,
            CASE WHEN c_custkey % 10 IN (0, 1) THEN 'empty project path' WHEN c_custkey % 10 IN (2, 3) OR (c_custkey % n) % 10 = 9 THEN 'project path not found' END reason,
            c_custkey % 10 > 3 AND (c_custkey % n) % 10 <> 9 accepted
          FROM (SELECT c_custkey, CASE c_custkey % 10 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '   ' WHEN 3 THEN '/srv/gone' || c_custkey ELSE '/srv/p' || (c_custkey % n) END project_path, n FROM customer, (SELECT count(*) n FROM supplier))""",
        "unsupported_projects": """
          SELECT 'p' || s_suppkey project, CASE s_suppkey % 10 WHEN 9 THEN 'no readable manifest' ELSE 'no supported parser' END reason FROM supplier WHERE s_suppkey % 5 = 4""",
        "rejects": _q("SELECT project, path, 'brackets do not close' reason FROM bro"),
        "folder_tree": _q("SELECT project, node, depth::INT AS depth, name, line FROM tre", ALL_PATHS),
        "classes": _q(f"SELECT {CLASS_COLS} FROM cls", CLS),
        "entities": _q(f"SELECT {CLASS_COLS} FROM cls WHERE kind = 'entity'", CLS),
        "plain_classes": _q(f"SELECT {CLASS_COLS} FROM cls WHERE kind = 'class'", CLS),
        "methods": _q(f"SELECT project, path, file_pos::INT pos, name, params, ret return_type, {IO.format('ret')} docs FROM mth", CLS),
        "routes": _q(f"SELECT *, {IO.format('return_type')} docs FROM rou", CLS),
        "routes_lazy": _q(f"SELECT project, path, pos, name, CASE WHEN name = 'helper' THEN 'PUT' ELSE method END AS method, CASE WHEN name = 'helper' THEN '/full/:id' ELSE route END route, params, return_type, {IO.format('return_type')} docs FROM rou", CLS),
        "decorated_statements": _q(f"SELECT project, path, pos::INT pos, statement FROM ({numbered})"),
        "properties": _q("SELECT p.project, p.path, class_pos::INT class_pos, c.name AS class, c.kind, p.pos::INT pos, p.name, p.type, dec decorators FROM prp p JOIN cls c USING (project, path, class_pos)", CLS),
        "class_properties": _q("SELECT r.project, r.path, class_pos::INT class_pos, c.name AS class, c.kind, r.pos::INT pos, r.name, r.type, dec decorators FROM raw r JOIN cls c USING (project, path)", CLS, RAW_PROPERTIES.replace("{{", "{").replace("}}", "}")),
        "property_decorators": _q("SELECT p.project, p.path, class_pos::INT class_pos, c.name AS class, p.pos::INT property_pos, p.name property, unnest(range(len(string_split(dec, ','))))::INT pos, unnest(string_split(dec, ',')) decorator FROM prp p JOIN cls c USING (project, path, class_pos)", CLS),
        "class_methods": _q(f"SELECT m.project, m.path, class_pos::INT class_pos, c.name AS class, c.kind, m.pos::INT pos, m.name, params, ret return_type, {IO.format('ret')} docs FROM mth m JOIN cls c USING (project, path, class_pos)", CLS),
        "class_methods_by_file": _q(f"SELECT m.project, m.path, c.class_pos::INT class_pos, c.name AS class, c.kind, m.file_pos::INT pos, m.name, params, ret return_type, {IO.format('ret')} docs FROM mth m JOIN cls c USING (project, path)", CLS),
        "class_records": _q(f"""SELECT {CLASS_COLS.replace('name,', 'c.name,')}, coalesce(ms, '') methods, coalesce(ps, '') properties FROM cls c
          LEFT JOIN (SELECT project, path, class_pos, string_agg(name || ':' || ret, ';' ORDER BY pos) ms FROM mth GROUP BY ALL) USING (project, path, class_pos)
          LEFT JOIN (SELECT project, path, class_pos, string_agg(name || ':' || type || '@' || replace(dec, ',', '@'), ';' ORDER BY pos) ps FROM prp GROUP BY ALL) USING (project, path, class_pos)""", CLS),
        "relationships": _q("SELECT * FROM edg", CLS),
        "relationships_by_file": _q("SELECT * FROM edg WHERE property_pos = 1 UNION ALL SELECT project, path, 1, 1, 0, 'Rest' || k, 'C' || k, 'ManyToOne' FROM bro", CLS),
        "interfaces": _q(f"SELECT DISTINCT project, path, type_pos, type_name AS name, '/' || path file_path, '{INTERFACE_DOCS}' docs FROM fld WHERE kind = 'interface'", *types_ctes),
        "interface_properties": _q("SELECT project, path, type_pos, type_name interface, pos, name, type FROM fld WHERE kind = 'interface'", *types_ctes),
        "interface_refs": _q('SELECT project, path, class_pos type_pos, property_pos, pos, "from", "to", type FROM ife', CLS),
        "controllers": _q("SELECT project, path, 'P' || k || 'Controller' controller, 'parts' base_route FROM par UNION ALL SELECT project, path, 'S' || k || 'Controller', '{ path: shapes }' FROM sup"),
        "endpoints": _q("SELECT * EXCLUDE (response) FROM epd", END),
        "endpoint_params": _q("SELECT * EXCLUDE (shown) FROM epp", END),
        "endpoint_param_map": _q("SELECT e.project, e.path, e.pos, e.method_name, coalesce(string_agg(key || '=' || name || ':' || type, ';' ORDER BY key), '') params FROM epd e LEFT JOIN epp p ON p.project = e.project AND p.path = e.path AND p.pos = e.pos GROUP BY ALL", END),
        "endpoint_responses": _q("SELECT project, path, pos, method_name, return_type, response FROM epd", END),
        "enums": _q(f"SELECT project, dto path, 'Kind' || k AS enum, pos, me member FROM par, {_values([(0, 'SMALL'), (1, 'LARGE')], 'pos, me')} UNION ALL SELECT project, path, 'Mode' || k, pos, me FROM sup, {_values([(0, 'ON'), (1, 'OFF')], 'pos, me')}"),
        "type_fields": _q("SELECT project, path, type_pos::INT type_pos, type_name, kind, pos::INT pos, name, type FROM fld", *types_ctes),
        "imports": _q("SELECT * FROM imp", IMP),
        "classify_types": _q("""SELECT project, path, type_name, name, type, CASE WHEN type IN ('string', 'number') THEN 'scalar' WHEN type = 'Date' THEN 'date' WHEN name = 'opt' THEN 'union'
          WHEN name IN ('lines', 'self') OR type = 'string[]' OR (name = 'list') THEN 'array' WHEN name = 'meta' THEN 'inline' WHEN name = 'tags' THEN 'other' ELSE 'ref' END type_kind FROM fld""", *types_ctes),
        "unwrap_types": _q("""SELECT project, path, type_name, name, type, replace(replace(replace(replace(CASE WHEN name = 'tags' AND type LIKE '[%' THEN type || '!' ELSE type END, '[]', ''), ' | undefined', ''), 'Array<', ''), '>', '').replace('!', '') AS base,
          name IN ('lines', 'self', 'list') OR type = 'string[]' is_array FROM fld""", *types_ctes),
        "resolve_types": _q(REFS),
        "exports": _q(EXPORTS, MOD),
        "module_targets": _q(TARGETS, MOD),
        "resolve_types_modules": _q(MODULE_REFS, MOD),
        "field_lines_modules": _q(MODULE_TREES, MOD),
        "type_closure": _q("SELECT project, root_path, root_name, node, depth::INT AS depth, field, type_text, kind, type_name, is_array FROM nod", NODES, **trees),
        "circular_types": _q("SELECT project, root_path, root_name, node, depth::INT AS depth, field, type_text, kind, type_name, is_array FROM nod WHERE kind = 'circular'", NODES, **trees),
        "type_cycles": _q(CYCLES, RIN),
        "shared_types": _q(SHARED, RIN),
        "field_lines": _q(f"SELECT {TREE_COLS} FROM tli", NODES, **trees),
        "field_lines_json": _q(f"""SELECT {TREE_COLS} FROM tli WHERE kind <> 'circular' UNION ALL
          SELECT project, root_path, root_name, node, i::INT, indent::INT, ls[i + 1] FROM (SELECT *, [x FOR x IN ['- ' || field || ':', '  {{', '    "name": "' || type_name || '",', '    "fields": "[Circular Reference]"' || CASE WHEN is_array THEN ',' ELSE '' END, CASE WHEN is_array THEN '    "isArray": true' END, '  }}'] IF x IS NOT NULL] ls FROM tli WHERE kind = 'circular'), range(6) r(i) WHERE i < len(ls)""".replace("{{", "{").replace("}}", "}"), NODES, **trees),
        "enum_lines": _q(f"SELECT {TREE_COLS} FROM tli WHERE kind = 'enum'", NODES, **trees),
        "erd_edges": _q('SELECT * FROM dra', CLS, ALL_EDGES),
        "erd_text": _q(ERD_TEXT, CLS, ALL_EDGES),
        "erd_lines": _q(f"SELECT {LINE_COLS} FROM ({ERD_LINES})", CLS, ALL_EDGES),
        "write_erd": _q(f"SELECT e.* FROM ({ERD_TEXT}) e JOIN spr USING (project) WHERE has", CLS, ALL_EDGES),
        "parse_project_json": _q(
            f"SELECT parsed.*, js.json again FROM ({PARSED_JSON}) parsed JOIN ({PROJECT_JSON_ROWS}) js USING (project, path)",
            CLS,
            FLD,
            CATALOGUE,
        ),
        "project_json": _q(PROJECT_JSON_ROWS, CLS, FLD, CATALOGUE),
        "entity_table_rows": _q(f"SELECT {LINE_COLS} FROM ({ENTITY_TABLES})", CLS, FLD, ENT),
        "class_doc_lines": _q(f"SELECT {LINE_COLS} FROM ({CLASS_LINES})", CLS),
        "function_doc_lines": _q(f"SELECT {LINE_COLS} FROM ({FUNCTION_LINES})", CLS),
        "endpoint_doc_lines": _q(f"SELECT {LINE_COLS} FROM ({ENDPOINT_LINES})", NODES, END, **trees),
        "document_lines": _q(f"SELECT {LINE_COLS} FROM ({_all_lines()})", *everything, **trees),
        "write_documents": _q(f"SELECT {LINE_COLS} FROM ({_all_lines()})", *everything, **trees),
        "documents_text": _q(f"SELECT project, section::INT section, part::INT part, path, string_agg(text, chr(10) ORDER BY [x::INT FOR x IN string_split(ord, '.') IF x <> ''], line) AS text FROM ({_all_lines()}) GROUP BY ALL", *everything, **trees),
        "toc": _q(f"SELECT project, section::INT section, part::INT part, path, ord, line::INT line, right(style, 1)::INT AS level, text FROM ({_all_lines()}) WHERE style LIKE 'heading%'", *everything, **trees),
        "text_functions": """
          SELECT p_partkey, contains(p_name, 'a') has_a, starts_with(p_name, 'p') starts_p, ends_with(p_type, 'L') ends_l, p_name trimmed, upper(p_name) upper_name, lower(p_type) lower_type,
            len(string_split(p_name, ' '))::INT n_words, replace(p_name, ' ', chr(10)) on_lines, p_name unquoted, '/a/' || p_brand as_path, p_brand base, p_name || ' (' || p_type || ')' formatted,
            repeat('  ', (p_partkey % 4)::INT) indent, CASE WHEN p_type = '' THEN 'unknown' ELSE coalesce(p_type, 'unknown') END or_unknown, regexp_extract(p_name, '(\\w+)', 1) first_word,
            len(regexp_extract_all(p_name, '\\w+'))::INT n_found, regexp_matches(p_name, '^[a-z]') starts_lower, '2024-01-31' stamp, p_partkey::VARCHAR key_text, ' ' || chr(9) || p_name || chr(10) || ' ' newlines
          FROM part""",
    }
    out["text_functions_documents"] = """
      SELECT k, md5(trim(t, ' ' || chr(9) || chr(10) || chr(13))) trimmed, md5(t) newlines, md5(replace(replace(t, '"', ''), chr(39), '')) unquoted,
        md5('/a/' || replace(t, chr(92), '/')) as_path, len(string_split(t, chr(10)))::INT n_lines, contains(t, 'the') has_the
      FROM (SELECT doc_id k, text t FROM documents UNION ALL SELECT -1 - n_nationkey, n_name FROM nation)"""
    out["read_tree"] = _q("""
      SELECT project, path, md5(CASE WHEN k % 10 = 0 THEN replace(x, '@@', 'export abstract ') ELSE replace(x, '@@', '@Entity()' || chr(10) || 'export ') END || CASE WHEN k % 2 = 1 THEN chr(10) || 'class H' || k || ' {' || chr(10) || '}' ELSE '' END) AS content
      FROM (SELECT project, path, k, replace(replace(replace(CUSTOMER_TEXT, '#', k::VARCHAR), '%', n::VARCHAR), '^', CASE WHEN k % 2 = 1 THEN '@Column()' ELSE '@Column({ type: ''varchar'' })' END) x FROM cust)""".replace("CUSTOMER_TEXT", "'" + CUSTOMER_TEXT.replace("'", "''") + "'"))
    out["scan_sources"] = _q(f"SELECT project, path FROM ({scan})")
    out["scan_src_only"] = _q(f"SELECT project, path FROM ({scan} UNION ALL SELECT project, 'src/s' || k || '.d.ts' FROM sup)")
    return out
