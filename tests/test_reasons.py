"""One literal text per failure rule, with the expected label written out."""

import pytest

from runlore.functions import errors

# A line that only this rule should explain, and its label, in the order of the rules.
COMPILE = [
    ("warnings found and -Werror specified", "compile failed due to warnings found and werror specified"),
    ("Expected 2 positional arguments, but saw 3", "compile failed due to incompatible argument numbers"),
    ("Argument x should not be passed to this method", "compile failed due to incompatible argument types"),
    ("The method f(int) is not applicable for the arguments (String)", "compile failed due to incompatible arguments"),
    ("incompatible types: possible lossy conversion from long to int", "compile failed due to incompatible types"),
    ("incompatible types: String cannot be converted to int", "compile failed due to incompatible types"),
    ("incompatible types: inference variable T has incompatible bounds", "compile failed due to incompatible types"),
    ("cannot find symbol", "compile failed due to cannot find symbol"),
    ("class file for a.B not found", "compile failed due to class file not found"),
    ("int cannot be dereferenced", "compile failed due to type cannot be dereferenced"),
    ("A is not abstract and does not override abstract method f()", "compile failed due to does not override abstract method"),
    ("invalid method declaration; return type required", "compile failed due to return type required"),
    (
        "non-static type variable T cannot be referenced from a static context",
        "compile failed due to non-static type variable be referenced from a static context",
    ),
    ("Type mismatch: required 'A' but", "compile failed due to type mismatch"),
    ("type mismatch (type annotations): cannot convert from A to B", "compile failed due to type mismatch"),
    ("constraint mismatch: The type A is not a valid substitute", "compile failed due to constraint mismatch"),
    ("The import a.b cannot be resolved", "compile failed due to import cannot be resolved"),
    ("Unhandled exception type IOException", "compile failed due to unhandled exception type"),
    ("x cannot be resolved to a variable", "compile failed due to field cannot be resolved"),
    ("##[error]A.java: y cannot be resolved", "compile failed due to field cannot be resolved"),
    ("The blank final field z may not have been initialized", "compile failed due to field cannot be resolved"),
    ("Illegal redefinition of parameter p", "compile failed due to illegal redefinition of parameter"),
    ("The type A must implement the inherited abstract method B.f()", "compile failed due to inherited abstract method must implement"),
    ("The type A is already defined", "compile failed due to type already defined"),
    ("missing return statement", "compile failed due to return statement missing"),
    ("Duplicate method f() in type A", "compile failed due to duplicate method"),
    ("class, interface, or enum expected", "compile failed due to class or interface expected"),
    ("variable parameters is already defined in method f", "compile failed due to variable parameters already defined"),
    ("class file has wrong version 61.0, should be 55.0", "compile failed due to syntax version mismatch"),
    ("The import a.B collides with another import statement", "compile failed due to import collides"),
    (
        "The Java feature 'Records' is only available with source level 16 and above",
        "compile failed due to release version does not supported",
    ),
]
GOAL = [
    ("You have 3 Checkstyle violations", "checkstyle violation detected"),
    ("You have 1 PMD violation", "PMD violation detected"),
    ("The following files had format violations", "format violations detected"),
    ("Some Enforcer rules have failed", "enforce rule has failed"),
    ("Code Analysis Tool has found 2 error(s)", "code analysis tool has found error"),
    ("APILyzer found 4 problems", "api analyzer found problem"),
    ("File 'A.java' has not been previously formatted", "file format is non-compliant"),
    ("failed with 2 bugs and 0 errors", "spotbugs found bugs"),
    ("Imports are not sorted in A.java", "imports are not sorted"),
    ("The file pom.xml is not sorted", "file is not sorted"),
    ("Unsupported class file major version 65", "dependency version too old"),
    ("Error while generating Javadoc", "error while generating Javadoc"),
    (
        "the compiler encountered an XPath expression containing '101' operators that exceeds the '100' limit set by",
        "compile failed due to operators limit exceed",
    ),
    ("An error has occurred in Javadoc report generation", "error while generating Javadoc"),
    ("reason: the Java file contained parse errors", "compile failed due to file contained parse errors"),
    ("Fatal error compiling: error: invalid flag: --release", "compile failed due to invalid flag"),
    ("Fatal error compiling: error: release version 21 not supported", "compile failed due to release version does not supported"),
    ("Some files do not have the expected license header", "files lack the expected license"),
    ("Detected JDK version 8 is not in the allowed range", "jdk_version_mismatch"),
    ("Too many files with unapproved license: 3", "files lack the expected license"),
    ("Failed to find Licenses for 2 artifacts", "artifacts lack the expected license"),
    ("Timeout after 500 ms while waiting on log out", "time_out"),
    ("Container stopped with exit code 137 unexpectedly", "container stopped unexpectedly"),
    ("Failed to load class for package a.b", "failed to load package"),
    ("A required class was missing while executing x", "failed to load package"),
    ("Unable to find a comment style definition for some files", "could not find comment style definition"),
    ("Java heap space", "java heap space"),
    ("Premature end of Content-Length delimited message body", "data_transmission_interrupted"),
    ("Unable to check file A.java error: ';' expected", "failed to check file due to character expected"),
    ("Unable to format file A.java error: illegal start of expression", "failed to check file due to illegal start of expression"),
    ("An error has occurred in Checkstyle report generation", "checkstyle report generation occurred error"),
    ("Connect to host:443 failed: Connection refused", "connection_refused"),
    ("x.exe is not a valid Win32 application", "application is not supported"),
    ("java.io.EOFException", "EOFException"),
    ("Could not download a.jar: SSL peer shut down incorrectly", "ssl connection closed"),
    ("request GET x failed: Attempted read from closed stream", "connection_close"),
    ("Command execution failed.", "unknown"),
]
ANT = [
    (
        "error: incompatible types: incompatible parameter types in lambda expression",
        "compile failed due to incompatible types",
    ),
]
END = "Re-run Maven using the -X switch to enable full debug logging"
LOGS = {
    "compile": "Failed to execute goal x\nCompilation failure\n{}\n" + END,
    "goal": "Failed to execute goal x\n{}\n" + END,
    "ant": "{}\nBUILD FAILED\nCompile failed; see the compiler error output for details\nTotal time: 3 seconds",
}


@pytest.mark.parametrize(("form", "rules"), [("compile", COMPILE), ("goal", GOAL), ("ant", ANT)])
def test_every_rule_gives_its_label(spark, form, rules):
    rows = [(i, LOGS[form].format(line)) for i, (line, _) in enumerate(rules)]
    got = errors.with_error_reason(spark.createDataFrame(rows, "i int, log string"))
    assert {r.i: r.error_reason for r in got.collect()} == {i: label for i, (_, label) in enumerate(rules)}


def test_every_rule_is_listed():
    labels = [[label for _, label in rules] for rules in (COMPILE, GOAL, ANT)]
    assert labels == [[label for label, _ in t] for t in (errors.COMPILE_RULES, errors.MAVEN_RULES, errors.ANT_RULES)]


def test_rules_apply_in_their_order(spark):
    both = LOGS["compile"].format("cannot find symbol\nwarnings found and -Werror specified\nJava heap space")
    got = errors.with_error_reason(spark.createDataFrame([(both,)], "log string")).first().error_reason
    assert got == "compile failed due to warnings found and werror specified"
