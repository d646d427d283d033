"""Frame-to-frame jobs. Nothing here runs an action unless its docstring says so."""
