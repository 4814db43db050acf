"""TypeScript projects written out of the given tables.

The tables hold no source code, so every row of a table is turned into the text of
one or more source files, with Spark expressions only: no grouping, no collected
lists, one output row per input row and file.  The corpus grows with the tables.

Columns: ``project, path, content``.  ``FIXTURES.md`` lists the families.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcatlas.functions.storage import fresh_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_projects(spark: SparkSession, sf_dir: str) -> int:
    """One project for each supplier, so that projects grow with the data."""
    return table(spark, sf_dir, "supplier").count()


def fill(template: str, **values: Column) -> Column:
    """Template with ``<<name>>`` places as one concat expression."""
    parts = re.split(r"<<(\w+)>>", template)
    cols = [
        values[p].cast("string") if i % 2 else F.lit(p)
        for i, p in enumerate(parts)
        if p or i % 2
    ]
    return F.concat(*cols)


def _file(df: DataFrame, project: Column, path: Column, content: Column) -> DataFrame:
    return df.select(
        F.concat(F.lit("p"), project.cast("string")).alias("project"),
        path.alias("path"),
        content.alias("content"),
    )


def _by_project(key: Column, n: int) -> Column:
    return F.pmod(key, F.lit(n))


# --- one family per table ----------------------------------------------------

_CUSTOMER = """\
import { N<<n>> } from './n<<n>>.entity';

<<head>>class C<<k>> {
  @PrimaryGeneratedColumn()
  id: number;

  <<column>>
  name: string;

  @ManyToOne(() => N<<n>>)
  @JoinColumn()
  nation: N<<n>>;

  total(): number {
    const plain = this.name.replace(/\\(/g, '').replace(/[{]/g, "'");
    return 1;
  }
}
<<helper>>"""


def customer_files(spark: SparkSession, sf_dir: str, projects: int) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    head = F.when(k % 10 == 0, "export abstract ").otherwise("@Entity()\nexport ")
    column = F.when(k % 2 == 1, "@Column()").otherwise("@Column({ type: 'varchar' })")
    helper = F.when(k % 2 == 1, fill("class H<<k>> {\n}\n", k=k)).otherwise("")
    text = fill(_CUSTOMER, k=k, n=n, head=head, column=column, helper=helper)
    path = fill("src/entities/c<<k>>.entity.ts", k=k)
    return _file(df, _by_project(k, projects), path, text)


_ORDER = """\
@Entity({ name: 'orders' })
export class O<<k>> {
  @PrimaryColumn()
  key: number;

  @ManyToOne(() => C<<c>>, (c) => c.orders)
  customer: C<<c>>;

  @OneToMany((t) => L<<k>>, (l) => l.order, { cascade: true })
  public lines: L<<k>>[];

  async total(tax: number, rate: number): Promise<number> {
    const note = `${tax}: ${rate > 1 ? `x{${rate}` : '}'}`;
    return /['"`]/.test(note) ? 0 : tax * rate;
  }
}
"""


def order_files(spark: SparkSession, sf_dir: str, projects: int) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return _file(
        df, _by_project(c, projects), fill("src/orders/o<<k>>.entity.ts", k=k), fill(_ORDER, k=k, c=c)
    )


_DTO = """\
<<imports>>export enum Kind<<k>> { SMALL, LARGE }
export class D<<k>> {
  size: number;
  parent: D<<pk>>;
  kind: Kind<<k>>;
}
"""

_PART_CONTROLLER = """\
import { D<<k>> } from '../dto/d<<k>>.dto';
@Controller('parts')
export class P<<k>>Controller {
  @Get('<<s>>')
  get<<k>>(id: string): Promise<D<<k>>> {
    return null;
  }
  @Post()
  put<<k>>(@Body() body: D<<k>>, @Param('id') id: string): Promise<void> {
    return null;
    if (id) /[{(]/.test(id);
    switch (id) { case /a{/.source: break; }
    const kind = typeof /}/;
  }
  private readonly mark = /[)}]\\/\\(/g;
}
"""


def part_files(spark: SparkSession, sf_dir: str, projects: int) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    k = F.col("p_partkey")
    pk = F.expr(f"((p_partkey div {projects}) div 2) * {projects} + p_partkey % {projects}")
    imports = F.when(pk == k, "").otherwise(
        fill("import { D<<pk>> } from './d<<pk>>.dto';\n", pk=pk)
    )
    dto = _file(
        df,
        _by_project(k, projects),
        fill("src/dto/d<<k>>.dto.ts", k=k),
        fill(_DTO, k=k, pk=pk, imports=imports),
    )
    controller = _file(
        df,
        _by_project(k, projects),
        fill("src/api/p<<k>>.controller.ts", k=k),
        fill(_PART_CONTROLLER, k=k, s=F.col("p_size")),
    )
    return dto.unionByName(controller)


_INTERFACE = """\
export interface IUser<<u>> {
  id: number;
  friend: IUser<<v>>;
  tags: [ITag<<u>>];
  list: IUser<<v>>[];
}
"""


def interface_files(spark: SparkSession, sf_dir: str, projects: int) -> DataFrame:
    df = table(spark, sf_dir, "events").select("user_id").distinct()
    u = F.col("user_id")
    return _file(
        df,
        _by_project(u, projects),
        fill("src/models/u<<u>>.ts", u=u),
        fill(_INTERFACE, u=u, v=u + 1),
    )


_SHAPES = """\
import { Controller, Put } from '@nestjs/common';
import { Far<<k>> as Near<<k>> } from './far/f<<k>>.dto';
export enum Mode<<k>> { ON = 'on', OFF = 'off' }
export class Leaf<<k>> {
  v: string;
}
export interface Box<<k>> {
  leaf: Leaf<<k>>;
  n: number;
}
export class Crate<<k>> {
  leaf: Leaf<<k>>;
}
export class Pair<<k>> {
  left: Box<<k>>;
  right: Crate<<k>>;
  when: Date;
  tags: string[];
  opt?: Leaf<<k>> | undefined;
  list: Array<Leaf<<k>>>;
  meta: { a: string; b: Leaf<<k>> };
  mode: Mode<<k>>;
  far: Near<<k>>;
  self: Pair<<k>>[];
}
// @Controller('not this one') {
@Controller({ path: 'shapes' })
export class S<<k>>Controller {
  constructor(private readonly s: Service) {}

  @Put('/full/:id')
  async full(@Param('id') id: string, @Body() body: Pair<<k>>, @Query('m') mode: 'a' | 'b', plain: number): Promise<Pair<<k>>[]> {
    if (id === '}') { return [{ a: 1 }, { b: 2 }] as any; }
    return [];
  }

  @Delete()
  drop(@Query('kind') kind: Mode<<k>>, @Query('again') again: any): void {
    return;
  }

  @Patch('x')
  nothing() {
    return 1;
  }

  private readonly open = [/\\{/, /[(]/g, `${'`'}{`];

  helper(a: number): string {
    return 'h';
  }
}
@Controller('second')
export class Second<<k>>Controller {
  @Get('no')
  no(id: string): string {
    return '';
  }
}
"""


def supplier_files(spark: SparkSession, sf_dir: str, projects: int) -> DataFrame:
    df = table(spark, sf_dir, "supplier").select("s_suppkey")
    k = F.col("s_suppkey")
    dropped = fill("export class X<<k>> {\n}\n", k=k)
    far = fill("export class Far<<k>> {\n  deep: string;\n}\n", k=k)
    files = [
        ("node_modules/s<<k>>/index.ts", dropped),
        ("src/s<<k>>.d.ts", dropped),
        ("src/shapes/s<<k>>.controller.ts", fill(_SHAPES, k=k)),
        ("src/shapes/far/f<<k>>.dto.ts", far),
    ]
    return reduce(
        DataFrame.unionByName, [_file(df, k, fill(p, k=k), text) for p, text in files]
    )


_DOCUMENT = """\
/**
 * <<text>>
 */
export class T<<k>> {
  @Column({ comment: '}' }) // it's "{" here
  body: string;

  /* { ( ' */
  size(): number { return this.body.split(/['"{]/).length; }
}
"""


def document_files(spark: SparkSession, sf_dir: str, projects: int) -> DataFrame:
    """Whole prose texts as comments: long, full of quotes, no code."""
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    text = F.replace(F.col("text"), F.lit("*/"), F.lit("* /"))
    text = F.replace(text, F.lit("\n"), F.lit("\n * "))
    return _file(
        df,
        _by_project(k, projects),
        fill("src/docs/t<<k>>.ts", k=k),
        fill(_DOCUMENT, k=k, text=text),
    )


_BROKEN = """\
@Entity()
export class B<<k>> {
  @Column()
  z: string;

  @ManyToOne(() => C<<k>>)
  owner: C<<k>>;

  count(a: number): number {
    if (a > 1) {
    return a;
  }
}
export class Rest<<k>> {
  after(): string {
    return '';
  }
}
"""


def broken_files(spark: SparkSession, sf_dir: str, projects: int) -> DataFrame:
    """A brace is missing: these files can only be read line by line."""
    k = F.col("s_suppkey")
    df = table(spark, sf_dir, "supplier").select("s_suppkey").filter(k % 3 == 0)
    return _file(df, k, fill("src/broken/b<<k>>.ts", k=k), fill(_BROKEN, k=k))


_PAGE = """\
export const html<<k>> = `<<html>>`;
export class V<<k>> {
  @Column()
  page: string;
}
"""


def page_files(spark: SparkSession, sf_dir: str, projects: int) -> DataFrame:
    """Whole web pages as template literals: brackets and quotes that are not code."""
    df = table(spark, sf_dir, "pages").select("page_id", "html")
    k = F.col("page_id")
    # as a template literal is written: its own signs are escaped
    html = F.replace(F.col("html"), F.lit("\\"), F.lit("\\\\"))
    html = F.replace(F.replace(html, F.lit("`"), F.lit("\\`")), F.lit("${"), F.lit("\\${"))
    return _file(
        df,
        _by_project(k, projects),
        fill("src/pages/v<<k>>.ts", k=k),
        fill(_PAGE, k=k, html=html),
    )


def plain_files(spark: SparkSession, sf_dir: str, projects: int) -> DataFrame:
    """Files that are not sources: they matter for path-only operators."""
    df = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"))
    n = F.col("n")
    empty = F.lit("")
    always = [".github/ci.yml", "dist/main.js", "src/distance/near.md", "README.md"]
    frames = [_file(df, n, F.lit(p), empty) for p in always]
    frames.append(
        _file(df.filter(n % 7 == 0), n, F.lit("prisma/schema.prisma"), F.lit("model A {}"))
    )
    return reduce(DataFrame.unionByName, frames)


# --- files that hand names on ----------------------------------------------------


_MODEL = """\
export class M<<k>> {
  v: string;
  twin: M<<k>>;
}
export default class Main<<k>> {
  m: M<<k>>;
}
export type Maybe<<k>><T> = T | null;
export type Rows<<k>> = Maybe<<k>><M<<k>>>[];
export type Box<<k>><T> = {
  item: M<<k>>;
  more: T;
};
export type Id<<k>> = string;
export type Ring<<k>> = Rong<<k>>;
type Rong<<k>> = Ring<<k>>;
export type Odd<<k>> =
  | null
  | { deep: M<<k>> };
"""
_INDEX = """\
// export * from './nothing';
export { M<<k>> as Model<<k>>, Maybe<<k>>, Rows<<k>>, Box<<k>>, Id<<k>>, Ring<<k>>, Odd<<k>> } from './model';
export { default as Main<<k>> } from './model';
export * from './loop';
"""
_LOOP = """\
export * from './index';
export class Only<<k>> {
  z: number;
}
"""
_BARREL = """\
export * from './m<<k>>';
<<more>>"""
_USER = """\
import { Model<<j>>, Main<<j>> as First, Only<<k>>, Rows<<k>>, Box<<k>>, Id<<k>>, Ring<<k>>, Odd<<k>>, Maybe<<k>> } from '<<barrel>>';
import Plain, * as all from '../lib/m<<k>>/model';
import { Injectable } from '@nestjs/common';
export class Use<<k>> {
  model: Model<<j>>;
  first: First;
  only: Only<<k>>[];
  rows: Rows<<k>>;
  box: Box<<k>><First>;
  id: Id<<k>>;
  ring: Ring<<k>>;
  odd: Odd<<k>>;
  plain: Plain;
  space: all.M<<k>>;
  out: Injectable;
}
@Controller('uses')
export class U<<k>>Controller {
  @Post('<<k>>')
  make(@Body() body: Use<<k>>): Promise<Maybe<<k>><Model<<j>>>> {
    return null;
  }
}
"""
#: Barrels in a chain, at most.
CHAIN = 3


def module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project for each supplier whose files hand names on: five files for each part, and a configuration.

    A part's barrel hands on its folder and, up to three in a chain, the barrel of the part before in its project.
    """
    n = n_projects(spark, sf_dir)
    df = table(spark, sf_dir, "part").select("p_partkey")
    k = F.col("p_partkey")
    step = F.expr(f"(p_partkey div {n}) % {CHAIN}")
    first = k - step * n
    more = F.when(step > 0, fill("export * from './m<<b>>.barrel';\n", b=k - n)).otherwise("")
    barrel = F.when(F.expr("(p_partkey div 2) % 2 = 0"), fill("@lib/m<<k>>.barrel", k=k)).otherwise(fill("../lib/m<<k>>.barrel", k=k))
    texts = [
        ("src/lib/m<<k>>/model.ts", fill(_MODEL, k=k)),
        ("src/lib/m<<k>>/index.ts", fill(_INDEX, k=k)),
        ("src/lib/m<<k>>/loop.ts", fill(_LOOP, k=k)),
        ("src/lib/m<<k>>.barrel.ts", fill(_BARREL, k=k, more=more)),
        ("src/app/u<<k>>.controller.ts", fill(_USER, k=k, j=first, barrel=barrel)),
    ]
    # keys are dealt before texts are made of them: keys alone are shuffled
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = F.array(*(F.struct(fill(path, k=k).alias("path"), text.alias("content")) for path, text in texts))
    dealt = df.repartition(parts, "p_partkey").select(k, F.explode(made).alias("f"))
    frames = [_file(dealt, _by_project(k, n), F.col("f.path"), F.col("f.content"))]
    s = F.col("s_suppkey")
    here = F.when(s % 2 == 0, '"@lib/*": ["gone/*", "src/lib/*"]').otherwise('"@lib/*": ["lib/*"], "@lib/m": ["lib/gone"],')
    config = fill(
        '{ // as written\n  "compilerOptions": { "baseUrl": "<<base>>", "paths": { "@*": ["none/*"], <<here>> } }\n}\n',
        base=F.when(s % 2 == 0, ".").otherwise("./src/"),
        here=here,
    )
    frames.append(_file(table(spark, sf_dir, "supplier"), s % n, F.lit("tsconfig.json"), config))
    return reduce(DataFrame.unionByName, frames)


# --- types in rings --------------------------------------------------------------

_RING = """<<imports>>export class R<<k>> {
  next: R<<next>>;
  leaf: Leaf<<k>>;
<<fields>>}

export class Leaf<<k>> {
  v: string;
}
<<controller>>"""
_RING_CONTROLLER = """
@Controller('r<<k>>')
export class R<<k>>Controller {
  @Get()
  one(): Promise<R<<k>>> {
    return null;
  }
}
"""
#: Types of a ring, and rings of a chain.
RING, RINGS = 3, 4


def ring_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with a class for each part: three of them are a ring, the last one of a ring has two fields of the first one of
    the next ring, up to four rings in a chain. An endpoint returns the first one of each chain."""
    n = n_projects(spark, sf_dir)
    k, ring, chain = F.col("k"), F.expr(f"k div {RING}"), F.expr(f"k div {RING * RINGS}")
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    # a window over a chain has as many rows as a chain has parts
    df = df.select("k", ring.alias("ring"), chain.alias("chain"))
    df = df.withColumn("after", F.lead("k").over(Window.partitionBy("chain").orderBy("k")))
    df = df.withColumn("first", F.min("k").over(Window.partitionBy("chain", "ring")))
    df = df.withColumn("start", F.min("k").over(Window.partitionBy("chain")))
    inside = F.coalesce(F.expr(f"after div {RING}") == F.col("ring"), F.lit(False))
    following = F.when(inside, F.col("after")).otherwise(F.col("first"))
    below = F.col("after").isNotNull() & ~inside
    imported = lambda j: fill("import { R<<j>> } from './r<<j>>';\n", j=j)
    text = fill(
        _RING,
        k=k,
        next=following,
        imports=F.concat(
            F.when(following != k, imported(following)).otherwise(""),
            F.when(below, imported(F.col("after"))).otherwise(""),
        ),
        fields=F.when(below, fill("  left: R<<j>>;\n  right: R<<j>>[];\n", j=F.col("after"))).otherwise(""),
        controller=F.when(k == F.col("start"), fill(_RING_CONTROLLER, k=k)).otherwise(""),
    )
    return _file(df, _by_project(F.col("chain"), n), fill("src/ring/r<<k>>.ts", k=k), text)


# --- inputs of the operators ---------------------------------------------------


FAMILIES = [
    customer_files,
    order_files,
    part_files,
    interface_files,
    supplier_files,
    broken_files,
    document_files,
    page_files,
    plain_files,
]
_written: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, made: Callable[[], DataFrame], dealt: bool = False) -> DataFrame:
    """Files written once per application to the shared folder, as a project table would be; ``dealt``: in enough parts already."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        target = fresh_dir(spark, name)
        # the tables come in few files, but generated text is far larger than what it is made from
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = made()
        (rows if dealt else rows.repartition(parts, "path")).write.parquet(target)
        _written[key] = target
    return spark.read.parquet(_written[key])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of all projects: the table the operators start from."""
    projects = n_projects(spark, sf_dir)
    return _once(spark, sf_dir, "files", lambda: reduce(DataFrame.unionByName, [f(spark, sf_dir, projects) for f in FAMILIES]))


def handing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the projects whose files hand names on."""
    return _once(spark, sf_dir, "modules", lambda: module_files(spark, sf_dir), dealt=True)


def ringed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files whose types form rings."""
    return _once(spark, sf_dir, "rings", lambda: ring_files(spark, sf_dir))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``.ts`` file, those that scans drop included."""
    return files(spark, sf_dir).filter(F.col("path").endswith(".ts"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest for each project but those whose key ends with 9."""
    df = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n")).filter("n % 10 <> 9")
    n = F.col("n")
    deps = (
        F.when(n % 5 == 0, '"typeorm":"1"')
        .when(n % 5 == 1, '"sequelize":"1"')
        .when(n % 5 == 2, '"mongoose":"1"')
        .when(n % 5 == 3, '"mongoose":"1","typeorm":"1"')
        .otherwise("")
    )
    return df.select(
        fill("p<<n>>", n=n).alias("project"),
        fill('{"name":"x","dependencies":{<<deps>>}}', deps=deps).alias("content"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One documentation request per customer; some empty, some unknown."""
    df = table(spark, sf_dir, "customer").select("c_custkey")
    projects = n_projects(spark, sf_dir)
    k = F.col("c_custkey")
    path = (
        F.when(k % 10 == 0, F.lit(""))
        .when(k % 10 == 1, F.lit(None).cast("string"))
        .when(k % 10 == 2, F.lit("   "))
        .when(k % 10 == 3, fill("/srv/gone<<k>>", k=k))
        .otherwise(fill("/srv/p<<n>>", n=_by_project(k, projects)))
    )
    return df.select(k.alias("request_id"), path.alias("project_path"))
