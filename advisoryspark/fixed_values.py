"""Fixed values.

Everything in this file is a fixed value of the data contract: rule names and
patterns (their order decides which label wins), labels, defaults, column
names, text formats and the seed records.  They are data, kept in their
natural order; the logic that uses them lives elsewhere.
"""

# Exploit rules, first match wins.
EXPLOIT_RULES = [
    ("RCE", r"remote code execution|rce|arbitrary code|execute.*command|execution of arbitrary"),
    ("XSS", r"cross.site scripting|xss|inject.*script|script.*inject|cross-site-scripting"),
    ("SQLi", r"sql injection|sql inject"),
    ("Buffer Overflow", r"buffer overflow|heap overflow|use.after.free|stack overflow|out.of.bounds|memory corruption|out-of-bounds"),
    ("Privilege Escalation", r"privilege escalat|elevation of privilege|gain.*privilege|local.*privilege|bypass security restrictions"),
    ("DoS", r"denial.of.service|\bdos\b|server crash|resource exhaustion|infinite loop|crash the server"),
    ("Command Injection", r"command injection|os command|shell injection|arbitrary.*command"),
    ("Info Disclosure", r"information disclosure|memory leak|sensitive.*leak|expose.*data|read.*arbitrary|unauthorized read"),
    ("Auth Bypass", r"improper auth|authentication bypass|man.in.the.middle|unauthorized access|missing.*auth|security bypass"),
    ("Path Traversal", r"path traversal|directory traversal|\.\./|local file inclusion"),
    ("CSRF", r"cross.site request forgery|csrf|cross-site request forgery"),
    ("Open Redirect", r"open redirect|url redirect|redirect.*attacker"),
]

# Component rules, first match wins.
COMPONENT_RULES = [
    ("Windows Kernel", r"windows kernel|win32k|ntoskrnl"),
    ("Linux Kernel", r"linux kernel"),
    ("Apache HTTP Server", r"apache http|apache web server|httpd"),
    ("Chrome / V8", r"google chrome|chromium|v8 engine"),
    ("OpenSSL", r"openssl"),
    ("Spring Framework", r"spring framework|spring boot|springframework"),
    ("WordPress", r"wordpress|wp-plugin|wp plugin"),
    ("Android", r"android"),
    ("Nginx", r"nginx"),
    ("Windows Print Spooler", r"print spooler|spoolsv"),
    ("Web Interface", r"web interface|web application|web app|http request|url|cookie"),
    ("Network Stack", r"tcp/ip|network stack|packet handling"),
    ("Browser", r"firefox|safari|\bedge\b|internet explorer|webkit|blink"),
    ("SSH / OpenSSH", r"openssh|ssh server|ssh client"),
    ("PHP", r"\bphp\b"),
    ("Microsoft Office", r"microsoft office|ms office|word|excel|outlook"),
    ("VMware", r"vmware|esxi|vcenter"),
    ("Cisco IOS", r"cisco ios|cisco router|cisco switch"),
    ("Database", r"\bmysql\b|\bpostgres\b|\bmongodb\b|\bsqlite\b|database"),
    ("Network Device", r"router|firewall|switch|gateway|vpn"),
    ("Java / JVM", r"\bjava\b|\bjvm\b|tomcat|jboss"),
    ("Python", r"\bpython\b|django|flask"),
    ("Container", r"\bdocker\b|kubernetes|\bk8s\b|container"),
    ("Memory / Buffer", r"out.of.bounds|buffer|heap|memory corruption|use.after.free"),
    ("File System", r"file upload|directory|path traversal|symlink|file.*parse"),
    ("Authentication", r"login|password|credential|session|token|oauth|saml"),
    ("Cryptography", r"tls|ssl|certificate|cipher|encrypt|decrypt"),
    ("Driver", r"\bdriver\b|firmware|bios|uefi"),
    ("API / Service", r"\bapi\b|rest.*endpoint|soap|graphql|microservice"),
    ("Email", r"smtp|imap|pop3|mail.*server|sendmail|postfix"),
]

# Impact flags, all that match are listed in this order.
IMPACT_RULES = [
    ("Code Execution", r"code execution|root access|system compromise|execute arbitrary"),
    ("Privilege Escalation", r"privilege escalat|elevation"),
    ("DoS", r"denial of service|crash|resource exhaustion"),
    ("Info Disclosure", r"information disclosure|memory leak|sensitive|expose"),
]

# The older research rule set.
RESEARCH_EXPLOIT_RULES = [
    ("RCE", r"remote code execution|rce|arbitrary code|execute.*command"),
    ("XSS", r"cross.site scripting|xss|inject.*script|script.*inject"),
    ("SQLi", r"sql injection|sql inject"),
    ("Buffer Overflow", r"buffer overflow|heap overflow|use.after.free|stack overflow|out.of.bounds"),
    ("Privilege Escalation", r"privilege escalat|elevation of privilege|gain.*privilege|local.*privilege"),
    ("DoS", r"denial.of.service|\bdos\b|server crash|resource exhaustion|infinite loop"),
    ("Command Injection", r"command injection|os command|shell injection|arbitrary.*command"),
    ("Info Disclosure", r"information disclosure|memory leak|sensitive.*leak|expose.*data|read.*arbitrary"),
    ("Auth Bypass", r"improper auth|authentication bypass|man.in.the.middle|unauthorized access|missing.*auth"),
    ("Path Traversal", r"path traversal|directory traversal|\.\./|local file inclusion"),
    ("CSRF", r"cross.site request forgery|csrf"),
    ("Open Redirect", r"open redirect|url redirect|redirect.*attacker"),
]

RESEARCH_COMPONENT_RULES = [
    ("Windows Kernel", r"windows kernel|win32k|ntoskrnl"),
    ("Linux Kernel", r"linux kernel"),
    ("Apache HTTP Server", r"apache http|apache web server|httpd"),
    ("Chrome / V8", r"google chrome|chromium|v8 engine"),
    ("OpenSSL", r"openssl"),
    ("Spring Framework", r"spring framework|spring boot|springframework"),
    ("WordPress", r"wordpress|wp-plugin|wp plugin"),
    ("Android", r"android"),
    ("Nginx", r"nginx"),
    ("Windows Print Spooler", r"print spooler|spoolsv"),
    ("Web Interface", r"web interface|web application|web app"),
    ("Network Stack", r"tcp/ip|network stack|packet handling"),
    ("Browser", r"firefox|safari|\bedge\b|internet explorer|webkit|blink"),
    ("SSH / OpenSSH", r"openssh|ssh server|ssh client"),
    ("PHP", r"\bphp\b"),
    ("Microsoft Office", r"microsoft office|ms office|word|excel|outlook"),
    ("VMware", r"vmware|esxi|vcenter"),
    ("Cisco IOS", r"cisco ios|cisco router|cisco switch"),
    ("Kernel / OS", r"\bkernel\b|\bos\b|operating system"),
    ("Web App", r"web application|\bwebapp\b|http request|url|cookie"),
    ("Database", r"\bmysql\b|\bpostgres\b|\bmongodb\b|\bsqlite\b|database"),
    ("Network Device", r"router|firewall|switch|gateway|vpn"),
    ("Java / JVM", r"\bjava\b|\bjvm\b|tomcat|jboss"),
    ("Python", r"\bpython\b|django|flask"),
    ("Container", r"\bdocker\b|kubernetes|\bk8s\b|container"),
    ("Memory / Buffer", r"out.of.bounds|buffer|heap|memory corruption|use.after.free"),
    ("File System", r"file upload|directory|path traversal|symlink|file.*parse"),
    ("Authentication", r"login|password|credential|session|token|oauth|saml"),
    ("Cryptography", r"tls|ssl|certificate|cipher|encrypt|decrypt"),
    ("Driver", r"\bdriver\b|firmware|bios|uefi"),
    ("API / Service", r"\bapi\b|rest.*endpoint|soap|graphql|microservice"),
    ("Email", r"smtp|imap|pop3|mail.*server|sendmail|postfix"),
]

RESEARCH_IMPACT_RULES = [
    ("Code Execution", r"code execution|root access|system compromise"),
    ("Privilege Escalation", r"privilege escalat|elevation"),
    ("DoS", r"denial of service|crash"),
    ("Info Disclosure", r"information disclosure|memory leak|sensitive"),
]

# Labels and defaults.
DEFAULT_EXPLOIT = "Other"
DEFAULT_COMPONENT = "Unknown"
DEFAULT_IMPACT = "Unknown"
DEFAULT_DESCRIPTION = "No English description available."
DEFAULT_FIRST_DESCRIPTION = "No description available"
DEFAULT_CWE = "N/A"
DEFAULT_YEAR = "Unknown"
DEFAULT_OS = "Cross-Platform"
RESEARCH_OS = "Unknown"
DEFAULT_SCORE = 0.0
FALLBACK_PREDICTED_SCORE = 5.0
THREAT_STATES = ["Low Threat", "Medium Threat", "High Threat"]
ZERO_SHOT_LABELS = ["critical severity", "high severity", "medium severity", "low severity"]

# Id formats.
ID_FORMAT = r"^CVE-\d{4}-\d{4,}$"
LOOSE_ID_FORMAT = r"^CVE-\d{4}-\d+$"
ID_YEAR = r"CVE-(\d{4})-"

# Column order and headings of the CSV export.
EXPORT_COLUMNS = [
    ("CVE_ID", "CVE ID"),
    ("Year", "Year"),
    ("CVSS_Score", "CVSS Score"),
    ("True_Severity", "Severity"),
    ("Exploit_Type", "Exploit Type"),
    ("Affected_Component", "Affected Component"),
    ("Description", "Description"),
]

# Text of the analyst prompt; %s are id, text, score, CWE, year.
PROMPT_FORMAT = """You are a CVE security analyst. Analyze this CVE and return a JSON object only — no markdown, no explanation.

CVE ID      : %s
Description : %s
CVSS Score  : %s
CWE         : %s
Year        : %s

Return exactly this JSON structure:
{
  "severity":           "CRITICAL|HIGH|MEDIUM|LOW|UNKNOWN",
  "cvss_score":         <number 0-10>,
  "exploit_type":       "<one of: RCE, XSS, SQLi, Buffer Overflow, Privilege Escalation, DoS, Command Injection, Info Disclosure, Auth Bypass, Path Traversal, CSRF, Open Redirect, Other>",
  "affected_component": "<specific software/library/system>",
  "impact":             "<brief impact: what can an attacker do>",
  "confidence":         <0-100>,
  "reasoning":          "<1-2 sentences explaining the severity rating>"
}"""

# Seed records (id, text, year, score, CWE, OS, exploit, component, impact, severity).
SEED_RECORDS = [
    ("CVE-2017-0144", "EternalBlue SMB Vulnerability. Remote code execution vulnerability in Microsoft Server Message Block 1.0 (SMBv1) protocol allows remote attackers to execute arbitrary commands.", "2017", 8.8, "CWE-119", "Windows", "RCE", "Windows Kernel", "Code Execution", "HIGH"),
    ("CVE-2014-0160", "Heartbleed OpenSSL. The TLS and DTLS implementations in OpenSSL 1.0.1 before 1.0.1g do not properly handle Heartbeat Extension packets, allowing remote attackers to obtain sensitive information from process memory.", "2014", 7.5, "CWE-119", "Linux", "Info Disclosure", "OpenSSL", "Info Disclosure", "HIGH"),
    ("CVE-2021-44228", "Apache Log4j2 JNDI Remote Code Execution (Log4Shell). Apache Log4j2 2.0-beta9 through 2.15.0 JNDI features used in configuration, log messages, and parameters do not protect against attacker controlled LDAP endpoints.", "2021", 10.0, "CWE-502", "Cross-Platform", "RCE", "Java / JVM", "Code Execution", "CRITICAL"),
    ("CVE-2021-34527", "PrintNightmare. Windows Print Spooler Remote Code Execution Vulnerability allows a local or remote attacker to bypass privilege restrictions and execute commands as SYSTEM.", "2021", 8.8, "CWE-269", "Windows", "RCE", "Windows Print Spooler", "Code Execution", "HIGH"),
    ("CVE-2020-1472", "Netlogon Privilege Escalation (Zerologon). An elevation of privilege vulnerability exists when an attacker establishes a vulnerable Netlogon secure channel connection to a domain controller using Netlogon protocol.", "2020", 10.0, "CWE-269", "Windows", "Privilege Escalation", "Authentication", "Privilege Escalation", "CRITICAL"),
    ("CVE-2019-11043", "PHP-FPM Remote Command Execution. In PHP-FPM, env_path_info underflow can cause an out-of-bounds memory write in the PHP buffer, leading to arbitrary code execution when combined with nginx configurations.", "2019", 9.8, "CWE-787", "Linux", "RCE", "PHP", "Code Execution", "CRITICAL"),
    ("CVE-2018-11776", "Apache Struts RCE. Apache Struts 2.3 to 2.3.34 and 2.5 to 2.5.16 allows remote command execution when namespace redirection is improperly checked during result execution.", "2018", 8.1, "CWE-20", "Cross-Platform", "RCE", "Web Interface", "Code Execution", "HIGH"),
    ("CVE-2023-38831", "WinRAR Arbitrary Code Execution. WinRAR allows remote attackers to execute arbitrary code because a crafted ZIP file contains duplicate directories leading to path parsing issues and execution of a payload.", "2023", 7.8, "CWE-22", "Windows", "Path Traversal", "File System", "Code Execution", "HIGH"),
    ("CVE-2022-22965", "Spring4Shell. Spring Framework RCE via data binding on JDK 9+. A Spring MVC or Spring WebFlux application running on JDK 9+ may be vulnerable to remote command execution through Parameter binding.", "2022", 9.8, "CWE-94", "Cross-Platform", "RCE", "Spring Framework", "Code Execution", "CRITICAL"),
    ("CVE-2024-21626", "runc Container Escape. runc is a CLI tool for spawning and running containers. In runc, a file descriptor leak allows an attacker to gain write access to the host directory and escape container isolation.", "2024", 8.6, "CWE-402", "Linux", "Auth Bypass", "Container", "Code Execution", "HIGH"),
    ("CVE-2023-49103", "ownCloud Info Leak. An issue in ownCloud graphapi app allows unauthenticated remote attackers to expose sensitive server environment variables, credentials, and PHP configuration.", "2023", 10.0, "CWE-200", "Linux", "Info Disclosure", "API / Service", "Info Disclosure", "CRITICAL"),
    ("CVE-2025-0199", "Router OS Command Injection. Realtek router SDK contains a stack-based buffer overflow in the web interface, permitting remote authenticated attackers to execute arbitrary shell commands via custom cookies.", "2025", 8.0, "CWE-121", "Firmware", "Command Injection", "Network Device", "Code Execution", "HIGH"),
    ("CVE-2026-9999", "Future Threat Zero-Day. Upcoming next-gen network stack vulnerability. A denial of service vulnerability discovered in network packet handling routines causes thread loops and resource exhaustion.", "2026", 5.5, "CWE-400", "Linux", "DoS", "Network Stack", "DoS", "MEDIUM"),
]
