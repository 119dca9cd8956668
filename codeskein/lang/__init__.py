"""Language front end: lexers, grammars, parsers and declarations of C# and C++."""
