"""Facts read from build manifests and workflow files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlore.functions.values import lines, truthy

# Files that name the build tool, in order of precedence.
BUILD_FILES = {
    "ruby": ["Gemfile", "Rakefile"],
    "java-ant": ["build.xml"],
    "java-maven": ["pom.xml"],
    "java-gradle": ["build.gradle", "settings.gradle", "build.gradle.kts"],
}

# Test frameworks in order, where each may be declared, and how.
FRAMEWORK_FILES = {
    "junit": ["pom.xml", "build.gradle"],
    "rspec": ["Gemfile", "Rakefile"],
    "testunit": ["Gemfile"],
    "cucumber-ruby": ["Gemfile", "Rakefile"],
    "cucumber-java": ["pom.xml", "build.gradle"],
    "phpunit": ["composer.json"],
    "pytest": ["requirements.txt", "setup.py", "pyproject.toml"],
    "unittest": ["requirements.txt", "setup.py", "pyproject.toml"],
    "jest": ["package.json"],
    "mocha": ["package.json"],
}
FRAMEWORK_MARKS = {
    "junit": r"junit",
    "rspec": r"rspec",
    "testunit": r"gem\s*['\"]test-unit['\"]",
    "cucumber-ruby": r"gem\s*['\"]cucumber['\"]|cucumber",
    "cucumber-java": r"cucumber-java|cucumber-junit|io.cucumber:cucumber",
    "phpunit": r'"phpunit/phpunit"',
    "pytest": r"pytest",
    "unittest": r"unittest",
    "jest": r'"jest"',
    "mocha": r'"mocha"',
}

# Manifests whose dependencies are counted, per repository root and per commit.
ROOT_MANIFESTS = ["pom.xml", "build.gradle", "requirements.txt", "Gemfile", "package.json", "composer.json"]
COMMIT_MANIFESTS = ["pom.xml", "build.gradle", "build.gradle.kts", "requirements.txt", "package.json", "Gemfile", "composer.json"]
JVM_MANIFESTS = ["pom.xml", "build.gradle", "build.gradle.kts"]
JVM_DEPENDENCY = r"<dependency>|implementation|compile|api|testImplementation"

# References from a workflow file to other places on the hosting service.
EXTERNAL_MARKS = [
    r"git@github\.com:[^\n+]\.git",
    r"https?://(api\.)?github\.com",
    r"(?d)^\s*uses:\s*([^/\s]+/[^/\s]+)/\.github/workflows/[^\s@]+@([^\s]+)$",
]

CI_CONFIG_PATH = r"^\.github/workflows/.*?\.(yaml|yml)"


def _members(document: Column, *names: str) -> Column:
    valid = F.try_parse_json(document).isNotNull()

    def size(name: str) -> Column:
        node = F.get_json_object(document, f"$['{name}']")
        return F.coalesce(F.size(F.json_object_keys(node)), F.json_array_length(node), F.lit(0))

    return F.when(valid, sum([size(n) for n in names[1:]], size(names[0]))).otherwise(0)


def dependency_count(content: Column, path: Column) -> Column:
    """Dependencies a manifest declares; 0 for empty content, a broken document or another file."""
    required = F.size(
        F.filter(lines(content), lambda l: l.rlike(r"(?U)\S") & ~l.startswith("#"))
    )
    count = (
        F.when(path.isin(JVM_MANIFESTS), F.regexp_count(content, F.lit(JVM_DEPENDENCY)))
        .when(path == "requirements.txt", required)
        .when(path == "package.json", _members(content, "dependencies", "devDependencies"))
        .when(path == "Gemfile", F.regexp_count(content, F.lit(r"(?md)^gem ")))
        .when(path == "composer.json", _members(content, "require", "require-dev"))
        .otherwise(0)
    )
    return F.when(truthy(content), count).otherwise(0).cast("long")


def build_language(root_files: Column) -> Column:
    """Build tool named by the first marker file among the root files; null without one."""
    chain = None
    for language, files in BUILD_FILES.items():
        hit = F.arrays_overlap(root_files, F.array(*[F.lit(f) for f in files]))
        chain = F.when(hit, language) if chain is None else chain.when(hit, language)
    return chain


def declared_frameworks(content: Column, path: Column) -> Column:
    """Array of (position, framework) that one manifest declares."""
    entries = [
        F.when(
            path.isin(files) & content.rlike(FRAMEWORK_MARKS[framework]),
            F.struct(F.lit(i).alias("position"), F.lit(framework).alias("framework")),
        )
        for i, (framework, files) in enumerate(FRAMEWORK_FILES.items())
    ]
    return F.filter(F.array(*entries), lambda e: e.isNotNull())


def has_external_reference(workflow: Column) -> Column:
    hit = F.lit(False)
    for pattern in EXTERNAL_MARKS:
        hit = hit | workflow.rlike(pattern)
    return F.coalesce(hit, F.lit(False))
