"""Plan helpers shared by the operators: staging in the shared folder, table access."""
