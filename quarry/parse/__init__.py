"""A shallow parser of JavaScript and TypeScript, run where the files lie."""
