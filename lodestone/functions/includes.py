"""Which C and C++ includes are no files of the project."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard headers and library prefixes that are never looked up.
STANDARD_HEADERS = (
    "iostream fstream sstream iomanip vector list deque queue stack map set unordered_map unordered_set "
    "algorithm numeric functional iterator string cstring cctype cmath memory utility stdexcept initializer_list "
    "cassert cerrno cfloat climits cstddef cstdint cstdio cstdlib ctime cwchar thread mutex condition_variable "
    "atomic future chrono ratio regex random complex valarray bitset ostream istream streambuf ios"
).split()
LIBRARY_PREFIXES = (
    "boost qt gl glm glfw sdl cuda cudart sys windows windows.h unistd pthread pthread.h dirent fcntl "
    "sys/socket netinet/in arpa/inet libxml libcurl curl openssl zlib bzip2 intrin immintrin __builtin"
).split()
SYSTEM_DIRECTORIES = "sys/ arpa/ netinet/ linux/ asm/".split()


def is_standard_header(name: Column) -> Column:
    bare = name
    for suffix in (".h", ".hpp", ".hxx"):
        bare = F.regexp_replace(bare, rf"(?:\{suffix})+$", "")
    return bare.isin(STANDARD_HEADERS)


def is_external_library(name: Column) -> Column:
    prefixes = "|".join(p.replace(".", r"\.") for p in sorted(LIBRARY_PREFIXES, key=len, reverse=True))
    return F.lower(name).rlike(rf"^(?:{prefixes})(?:[/_.]|$)") | name.rlike("|".join(SYSTEM_DIRECTORIES))


def is_filtered_include(name: Column) -> Column:
    return is_standard_header(name) | is_external_library(name)
