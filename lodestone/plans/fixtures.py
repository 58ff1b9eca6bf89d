"""Code generated from tables for the graph's queries, and a small package of our own for its tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.code_graph import CodeGraph, build, update
from lodestone.plans.lineage import spread

PACKAGE = {
    "zoo.py": '"""A zoo."""\nfrom .animals import Cat\nfrom .animals.base import *\n',
    "zoo.animals.py": '"""Animals."""\nfrom .cat import Cat\nfrom .dog import Dog as Hound\n',
    "zoo.animals.base.py": '"""Base classes."""\n\nclass Animal:\n    """Anything alive."""\n\n    def __init__(self, name):\n        self.name = name\n\n    def speak(self):\n        return self.noise()\n\n    def noise(self):\n        return ""\n\n\ndef register(animal):\n    """Keep an animal."""\n    return animal\n',
    "zoo.animals.cat.py": 'from .base import Animal, register\n\n\nclass Cat(Animal):\n    """A cat."""\n\n    def noise(self):\n        return "meow"\n\n    def groom(self):\n        self.noise()\n        self.speak()\n        self.fly()\n',
    "zoo.animals.dog.py": 'from . import base\n\n\nclass Dog(base.Animal):\n    def noise(self):\n        return "woof"\n\n    def fetch(self, ball: "Ball"):\n        ball.roll()\n        return base.register(self)\n',
    "zoo.toys.py": 'import os\nimport zoo.animals.cat as c\n\n\nclass Ball:\n    def roll(self):\n        return os.getcwd()\n\n    def bounce(self):\n        def again():\n            return self.roll()\n        return again()\n\n\ndef play(cat: c.Cat):\n    cat.groom()\n    cat.tail.wag()\n    return c.Cat("x")\n',
    "app.py": 'import zoo\nfrom zoo import Cat, register\nfrom zoo.animals import Hound\nimport numpy as np\n\nkeeper = Hound("rex")\n\n\ndef main():\n    keeper.fetch(None)\n    register(Cat("tom"))\n    np.zeros(3).fill(1)\n    thing().roll()\n    main()\n\n\ndef thing():\n    return zoo\n\n\nif __name__ == "__main__":\n    main()\n',
    "broken.py": "def oops(:\n",
    "empty.py": "",
}


def package(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PACKAGE.items()), "file string, text string")


_BUILT: dict[str, CodeGraph] = {}


def package_graph(spark: SparkSession) -> CodeGraph:
    """The package's graph, built once per application: its tables are written and can be read again."""
    return _built(spark, "package", lambda: build(package(spark)))


#: Modules of one generated package: its last one sees a name over twelve imports and a method over twelve classes.
CHAIN = 13


def _first_module(k: Column) -> Column:
    """A module that imports nothing and defines what the others of its package use."""
    return F.concat(F.lit("def f():\n    return 1\n\n\nclass C"), k, F.lit(":\n    def hello(self):\n        return f()\n"), _go(k))


def _go(k: Column) -> Column:
    return F.concat(F.lit("\n\ndef go():\n    c = C"), k, F.lit("()\n    f()\n    return c.hello()\n"))


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, text``: a module for each supplier, in packages of CHAIN modules that import from one another in a row."""
    k = F.col("k").cast("string")
    before = (F.col("k") - 1).cast("string")
    later = F.concat(F.lit("from .m"), before, F.lit(" import C"), before, F.lit(", f\n\n\nclass C"), k, F.lit("(C"), before, F.lit("):\n    pass\n"), _go(k))
    rows = spread(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k")))
    name = F.concat(F.lit("c"), F.floor(F.col("k") / CHAIN).cast("string"), F.lit(".m"), k, F.lit(".py"))
    return rows.select(name.alias("file"), F.when(F.col("k") % CHAIN == 0, _first_module(k)).otherwise(later).alias("text"))


def _built(spark: SparkSession, key: str, make: Callable[[], CodeGraph]) -> CodeGraph:
    """A graph built once per application: its tables are written and can be read again."""
    key = f"{spark.sparkContext.applicationId} {key}"
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def generated_graph(spark: SparkSession, sf_dir: str, without: str = "") -> CodeGraph:
    """The generated packages' graph (without one file)."""
    return _built(spark, f"{sf_dir} {without}", lambda: build(generated(spark, sf_dir).filter(F.col("file") != without)))


#: In every second package this module goes, in the others it no longer imports.
TURNED = 5


def turned_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The generated packages' graph, updated: module TURNED of even packages removed, of odd ones written anew as a first module."""

    def make() -> CodeGraph:
        rows = spread(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k")).filter(F.col("k") % CHAIN == TURNED))
        rows = rows.withColumn("file", F.concat(F.lit("c"), F.floor(F.col("k") / CHAIN).cast("string"), F.lit(".m"), F.col("k").cast("string"), F.lit(".py")))
        odd = F.floor(F.col("k") / CHAIN) % 2 == 1
        changed = rows.filter(odd).select("file", _first_module(F.col("k").cast("string")).alias("text"))
        return update(generated_graph(spark, sf_dir), changed, rows.filter(~odd).select("file"))

    return _built(spark, f"{sf_dir} turned", make)


#: Sources of one package that needs every rule of resolution; {k} is a supplier.
RULES = {
    "": "from .base import *\n",
    ".base": '''"""What package {k} rests on."""


class Base:
    """A base."""

    def __init__(self):
        self.ready()

    def ready(self):
        return 1

    def only{k}(self):
        return 2


def helper():
    return Base()
''',
    ".use": '''import os
import t{k}.base as b
from t{k} import Base as B, helper
from typing import Optional


class Child(B):
    def only{k}(self):
        return self.ready()


def typed(x: "B", y: Optional[B], z: B | None, w: b.Base):
    x.ready()
    y.only{k}()
    z.ready()
    w.only{k}()


def called(thing, p: os.PathLike):
    helper()
    b.helper()
    B()
    b.Base.ready(thing)
    thing.only{k}()
    thing.get()
    os.getcwd()
    p.only{k}()
''',
    ".long": "def long():\n    total = {k}\n" + "    total = total + {k} * (total - {k})\n" * 60 + "    return total\n",
    ".broken": "def oops(:\n" + "    # nothing here parses, and so it is cut as plain text\n" * 20,
}


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, text``: a package of RULES for each supplier."""
    k, rows = F.col("s_suppkey").cast("string"), spread(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey"))
    parts = F.array(*(F.struct(F.concat(F.lit("t"), k, F.lit(part + ".py")).alias("file"), F.replace(F.lit(text), F.lit("{k}"), k).alias("text")) for part, text in RULES.items()))
    return rows.select(F.explode(parts).alias("f")).select("f.*")


def ruled_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    return _built(spark, f"{sf_dir} ruled", lambda: build(ruled(spark, sf_dir)))
