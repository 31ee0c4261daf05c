"""Code-findings analytics as Spark jobs over tables of reports, findings, files and pushes."""
